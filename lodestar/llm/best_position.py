"""Ranked lexical search by the best position algorithm (operator 13).

Each asked term has an impact list: the documents that hold it by falling impact. Lists are read
side by side; every document met is scored whole by direct accesses, which tell its positions in all
the lists of the item. A list's best position is the last one up to which all positions have
been seen, by either way; no unseen document can have more than the sum of the impacts at
the best positions. When the k-th score is strictly above that sum the search stops; at equality it
goes on, since equal scores go by doc_id.

Documents are never shuffled. One pass keeps what each partition has of the asked terms (packed, settled) and
counts documents, terms and document frequencies; a second builds impact lists of at most ``SHARD`` postings at a time,
searches them for every item and hands its best k from one to the next, where they are the score to beat. The best of
all partitions are merged in two steps. Items are asked in blocks of about ``block_bytes`` of different texts, whose terms and
weights are broadcast; items with one text share its answer.

Nulls: a null text has no terms, of an item or of a document; an item without terms, or whose terms no document has, has no rows. A null doc_id comes after all
others among equal scores; a null item_id is an item. Repeated rows are ranked each, of documents and of items. Texts of any
length are read whole. Extra columns are ignored. An empty table of either gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_DOC, cut_lineage, flat_ranges, pack, slices, string_buffer, unpack

SHARD = 2_000_000  # postings that are searched at once
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The maximal runs of letters, digits and bytes beyond ASCII, with A-Z lower-cased."""
    return text.translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class ImpactLists:
    """Impact lists of some documents, and where each document stands in them."""

    def __init__(self, doc_id: np.ndarray, length: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int, n_docs: int, total: int):
        """doc, term, tf: postings by rising doc; n_docs, total: documents and terms of the whole corpus."""
        self.doc_id = doc_id
        m = np.array([75 + 25 * n * n_docs // total for n in length.tolist()], np.int64)
        self.term, self.impact = term, 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        order = np.lexsort((doc, -self.impact, term))
        self.listed_doc, self.listed_impact = doc[order], self.impact[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.row = np.searchsorted(doc, np.arange(len(doc_id) + 1))
        self.seen = np.zeros(len(order), bool)  # places, of one search
        self.met = np.zeros(len(doc_id), bool)
        self.weight = np.zeros(n_terms, np.int64)
        self.reads = 0  # documents scored so far

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray], step: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Scores and doc_ids of the best k of these documents and of ``best``, highest first; weights are above 0."""
        begin, end = self.begin[terms], self.begin[terms + 1]
        asked = end > begin
        terms, weights, begin, end = terms[asked], weights[asked], begin[asked], end[asked]
        self.weight[terms] = weights
        at, depth, touched, docs = begin.copy(), 0, [], []
        while len(terms):
            read = flat_ranges(begin + depth, np.clip(end - begin - depth, 0, step))
            depth, step = depth + step, 2 * step
            new = self.listed_doc[read]
            new = np.unique(new[~self.met[new]])
            self.met[new] = True
            docs.append(new)
            self.reads += len(new)
            # direct accesses: all that is known of the new documents
            sizes = self.row[new + 1] - self.row[new]
            held = flat_ranges(self.row[new], sizes)
            w = self.weight[self.term[held]]
            part = np.concatenate([[0], np.cumsum(w * self.impact[held])])
            ends = np.cumsum(sizes)
            best = _merge(best, part[ends] - part[ends - sizes], self.doc_id[new], k)
            places = self.place[held[w > 0]]
            self.seen[places] = True
            touched.append(places)
            limit = 0
            for i in range(len(terms)):
                ahead = self.seen[at[i] : end[i]]
                if len(ahead):
                    first = int(ahead.argmin())
                    at[i] += len(ahead) if ahead[first] else first
                    if at[i] < end[i]:  # a list that is seen whole has no unseen document
                        limit += int(weights[i]) * int(self.listed_impact[at[i] - 1])
            if (at == end).all() or (len(best[0]) == k and best[0][-1] > limit):
                break
        self.weight[terms] = 0
        for places in touched:
            self.seen[places] = False
        for new in docs:
            self.met[new] = False
        return best


def _merge(best: tuple[np.ndarray, np.ndarray], score: np.ndarray, doc_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    some = score > (best[0][-1] - 1 if len(best[0]) == k else 0)
    if not some.any():
        return best
    score, doc_id = np.concatenate([best[0], score[some]]), np.concatenate([best[1], doc_id[some]])
    order = np.lexsort((doc_id, -score))[:k]
    return score[order], doc_id[order]


_PACKED = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("postings", pa.binary())])


def _packed(docs: DataFrame, asked: dict[bytes, int]) -> DataFrame:
    """For every few MB of texts: documents with a term, all their terms, and the packed postings of asked terms."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        known = shared.value.get
        for batch in batches:
            data, offsets = string_buffer(batch.column(1))
            raw, ids = data.tobytes(), np.array([NO_DOC if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            for a, b in slices(np.diff(offsets) + 16, 4 << 20):
                length, doc, term, tf = np.zeros(b - a, np.int64), [], [], []
                for i in range(a, b):
                    found = terms_of(raw[offsets[i] : offsets[i + 1]])
                    length[i - a] = len(found)
                    held = Counter(map(known, found))
                    held.pop(None, None)
                    doc.append(len(held))
                    term.extend(held)
                    tf.extend(held.values())
                doc = np.repeat(np.arange(b - a, dtype=np.int32), doc)
                blob = pack(ids[a:b], length, doc, np.array(term, np.int32), np.array(tf, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([int((length > 0).sum())]), pa.array([int(length.sum())]), pa.array([blob], pa.binary())], schema=_PACKED)

    return docs.select("doc_id", "text").mapInArrow(run, "n_docs long, n_terms long, postings binary")


def _frequencies(packed: DataFrame, n: int) -> np.ndarray:
    """Of each of the n asked terms the documents that hold it."""

    def run(batches):
        df = np.zeros(n, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                df += np.bincount(unpack(blob)[3], minlength=n)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    out = np.zeros(n, np.int64)
    for r in packed.select("postings").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row an asked term at most
        out[r["term"]] = r["df"]
    return out


def _shards(blobs, limit: int):
    """Postings of consecutive packs, joined up to ``limit``."""
    held, size = [], 0
    for blob in blobs:
        new = unpack(blob)
        if held and size + len(new[2]) > limit:
            yield held
            held, size = [], 0
        held.append(new)
        size += len(new[2])
    if held:
        yield held


def _ask(docs: DataFrame, texts: list[tuple[str, str]], k: int, shard: int) -> DataFrame | None:
    """digest, doc_id, score: the best k of each partition for each of ``texts`` (digest, text)."""
    items = [(digest, Counter(terms_of((text or "").encode()))) for digest, text in texts]
    asked = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in items))))}
    if not asked:
        return None
    packed = cut_lineage(_packed(docs, asked))
    n_docs, total = packed.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not total:
        return None
    df = _frequencies(packed, len(asked))
    weights = np.array([weight(n_docs, x) if x else 0 for x in df.tolist()], np.int64)
    queries = []
    for digest, counts in items:
        terms = np.array([asked[t] for t in counts], np.int64)
        by = weights[terms] * np.array(list(counts.values()), np.int64) if len(terms) else terms
        queries.append((digest, terms[by > 0], by[by > 0]))
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in shared.value]
        for held in _shards((blob for batch in batches for blob in batch.column(0).to_pylist()), shard):
            first = np.cumsum([0, *(len(h[0]) for h in held)])
            ids, length, term, tf = (np.concatenate([h[j] for h in held]) for j in (0, 1, 3, 4))
            doc = np.concatenate([h[2].astype(np.int64) + f for h, f in zip(held, first, strict=False)])
            lists = ImpactLists(ids, length, doc, term.astype(np.int64), tf.astype(np.int64), len(df), n_docs, total)
            best = [lists.search(t, w, k, b) for (_, t, w), b in zip(shared.value, best, strict=True)]
        digest = np.repeat(np.array([q[0] for q in shared.value], object), [len(b[0]) for b in best])
        score, ids = (np.concatenate([b[j] for b in best]) for j in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(digest, pa.string()), pa.array(ids, pa.int64(), mask=ids == NO_DOC), pa.array(score, pa.int64())], names=["digest", "doc_id", "score"])

    return packed.select("postings").mapInArrow(run, "digest string, doc_id long, score long")


def best_position_search(docs: DataFrame, items: DataFrame, key: str = "item_id", k: int = 20, block_bytes: int = 8 << 20, shard: int = SHARD) -> DataFrame:
    """key, rank (from 1), doc_id, score: the k best rows of ``docs`` (doc_id long, text string) for each row of ``items`` (key, text string), scores above 0."""
    spark = docs.sparkSession
    named = items.select(key, "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    size, n = named.select(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = max(1, math.ceil((size or 0) / block_bytes))
    texts = named.groupBy("digest").agg(F.first("text").alias("text")).withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks)))
    texts = cut_lineage(texts) if blocks > 1 else texts
    found = [_ask(docs, [(r["digest"], r["text"]) for r in texts.where(F.col("block") == b).collect()], k, shard) for b in range(blocks)]  # about block_bytes of texts each
    found = [f for f in found if f is not None]
    if not found:
        return named.select(key).limit(0).selectExpr(key, "1 AS rank", "0L AS doc_id", "0L AS score")
    scored = reduce(DataFrame.union, found)

    def best(rows: DataFrame, *by) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    # each partition has its k best; some of them meet first, so that no item's are one task's
    some = best(scored.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))), "digest", "salt").drop("rank", "salt")
    top = best(some, "digest")
    return named.select(key, "digest").join(top, "digest").select(key, "rank", "doc_id", "score")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""WITH t AS (SELECT doc_id, row_number() OVER () AS row_, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, ask, term, count(*) AS c FROM (SELECT item_id, row_number() OVER () AS ask, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS total FROM t WHERE len(w) > 0),
p AS (SELECT row_, doc_id, n, term, count(*) AS tf FROM (SELECT row_, doc_id, len(w) AS n, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
v AS (SELECT row_, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // total))) AS v FROM p JOIN d USING (term), s),
r AS (SELECT item_id, ask, row_, doc_id, sum(c * v)::BIGINT AS score FROM q JOIN v USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0) WHERE rank <= 20"""
