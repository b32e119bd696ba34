"""Toxic spans and document scores from a linear-chain conditional random field (operator 8).

Labels come by document; the field needs them by token. To begin with, of each toxic
training document the word or beginning of a word (some languages compound) that the
toxic documents share most against the clean ones (signed G-squared) is its evidence;
what is the evidence of enough documents tags tokens as toxic. The field is fitted on
stretches of text around such tokens and on stretches of clean documents. On request
(``again``), the marginals then tag the tokens anew under the documents' labels and the
field is fitted again, with other stretches of toxic documents: no token of a clean
document is toxic, one at least of a toxic document with evidence is. The field gives
every token of every text its marginal probability. A document's score is a logistic
function of its largest marginal and of the chance that any token is toxic.

Training takes bounded samples: at most ``max_toxic`` and ``max_clean`` labelled
documents, the first by a hash of doc_id, and ``max_chains`` stretches of them.
Scoring reads every text whole, however long.

Nulls: a null or empty text scores as a text without toxic tokens. A null doc_id
is scored, never trained on, and not held out. Labels that are null are not used;
of several labels of a document the largest counts; of rows that repeat a doc_id the
model learns from the one with the least text, and each is scored. With no toxic or
no clean label, or no document, the model tags nothing and every document gets the
same low score. An empty table gives an empty result. Extra columns are ignored, or
kept as they are by ``remove_toxic``.
"""

from __future__ import annotations

import math
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, slices, small_batches, string_buffer
from .crf import Crf, Potentials, marginals
from .shingles import word_ranges

_EDGES = re.compile(r"^\W+|\W+$")
BEGINNINGS = (3, 4, 5, 6, 7)  # lengths of beginnings of words
_SIZES = [f"n={n}" for n in range(13)]
STRETCH = 48  # tokens of a training chain
LONGEST = 64  # characters of a token in one


def core(token: str) -> str:
    """A token in lower case without the punctuation around it."""
    word = token.strip(string.punctuation)
    return word if word.isalnum() else _EDGES.sub("", word)


def features(token: str) -> list[str]:
    token = token.lower()
    word = core(token)
    return ["bias", *units(word), _SIZES[min(len(word), 12)], "p" if word != token else "q", "l" if word.isalpha() else "d"]


def units(word: str) -> list[str]:
    """A word and its beginnings."""
    return ["w=" + word, *["b=" + word[:n] for n in BEGINNINGS if n < len(word)]]


def neighbour(token: str) -> list[str]:
    return ["w=" + core(token.lower())]


def tokens_of(text: str) -> list[str]:
    """Words between ASCII white space, in lower case. The beginning of a very long one stands for it."""
    return [t[:LONGEST] for t in re.split(r"[\x20\x09-\x0d]+", text.lower()) if t]


def split_fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5))


def word_evidence(sample: DataFrame, least: int) -> list[str]:
    """Units that are the strongest evidence of at least ``least`` toxic documents of the sample."""

    def split(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("word", pa.string())])
        for batch in batches:
            for doc, text, toxic in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                here = sorted({u for w in {core(t) for t in tokens_of(text.as_py() or "")} - {""} for u in units(w)})
                yield pa.RecordBatch.from_pydict({"doc_id": [doc] * len(here), "toxic": [toxic] * len(here), "word": here}, schema)

    words = sample.mapInArrow(split, "doc_id long, toxic int, word string")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return []
    counts = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("all")).where(f"t >= {least}")
    share = toxic / (toxic + clean)
    t, c = F.col("t"), F.col("all") - F.col("t")
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    gain = 2 * (term(t, F.col("all") * share) + term(c, F.col("all") * (1 - share)))
    # smoothed share of toxic documents among equally many of both kinds; a beginning must clearly beat the words that have it
    pure = (t / toxic) / (t / toxic + (c + 1) / clean)
    scored = counts.where(pure > 0.95).select("word", (gain * F.when(F.col("word").startswith("b="), 0.7).otherwise(1.0)).alias("gain"))
    best = words.where("toxic = 1").join(scored, "word").groupBy("doc_id").agg(F.max(F.struct("gain", "word")).alias("x"))
    found = best.groupBy("x.word").count().where(f"count >= {max(least, toxic // 100)}").orderBy("word")
    units_ = [r["word"] for r in found.collect()]  # no more than sampled documents
    whole = tuple(u[2:] for u in units_ if u.startswith("w="))
    return [u for u in units_ if u.startswith("w=") or not any(w.startswith(u[2:]) for w in whole)]


def _stretches(batches, lexicon: frozenset):
    """Training chains (kind 2: around tagged tokens of a toxic document; 1: from a toxic document without; 0: of a clean one, with a token like them, or else from the middle)."""
    alike = {u[2:5] for u in lexicon}
    for batch in batches:
        rows = []
        for doc, text, toxic in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            tokens = tokens_of(text or "")
            tags = [int(toxic == 1 and not lexicon.isdisjoint(units(core(t)))) for t in tokens]
            kind = 2 if any(tags) else int(toxic == 1)
            if kind == 2:
                starts = sorted({max(0, i - STRETCH // 2) // STRETCH * STRETCH for i, y in enumerate(tags) if y})
            elif kind == 1:
                starts = range(0, len(tokens), STRETCH)
            else:
                near = next((i for i, t in enumerate(tokens) if core(t)[:3] in alike), len(tokens) // 2)
                starts = [max(0, near // STRETCH * STRETCH)] if tokens else []
            rows += [(doc, s, tokens[s : s + STRETCH], tags[s : s + STRETCH], kind) for s in starts]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32()))], names=["doc_id", "start", "tokens", "tags", "kind"])


def retagged(crf: Crf, chains: list[tuple]) -> list[list[int]]:
    """Tags of chains (doc_id, kind, tokens, tags) by the field's marginals under the labels of their documents."""
    data, offsets = string_buffer(pa.array([" ".join(c[2]) for c in chains]))
    p, at = _marginals(data, offsets, Potentials(crf))
    out = [(p[at[i] : at[i + 1]] >= 0.5).astype(int) if kind else np.zeros(len(tokens), int) for i, (_, kind, tokens, _) in enumerate(chains)]
    best: dict[int, tuple] = {}  # of each document with evidence, its likeliest token
    for i, (doc, kind, _, _) in enumerate(chains):
        if kind == 2:
            own = p[at[i] : at[i + 1]]
            best[doc] = max(best.get(doc, (-1.0,)), (float(own.max()), -i, int(own.argmax())))
    for top, i, token in best.values():
        if top < 0.5:
            out[-i][token] = 1
    return [x.tolist() for x in out]


class ToxicModel:
    """A fitted field and the weights from its marginals to a score."""

    def __init__(self, crf: Crf, weights: tuple[float, float, float] = (-3.0, 0.6, 0.2)):
        self.crf, self.weights = crf, weights

    def score(self, top: np.ndarray, any_: np.ndarray) -> np.ndarray:
        z = self.weights[0] + self.weights[1] * top + self.weights[2] * any_
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _marginals(data: np.ndarray, offsets: np.ndarray, store: Potentials, ranges: bool = False):
    """The marginal of each token of texts in UTF-8 and the offsets of the texts in them; on request the tokens' ranges of bytes too."""
    start, end = word_ranges(data, offsets)
    at = np.searchsorted(start, offsets)
    if len(store.model.index) and len(start):
        p = marginals(store.unary(data, start, end, at), at, store.model.moves)[:, 1]
    else:
        p = np.zeros(len(start))
    return (p, at, start, end) if ranges else (p, at)


def _scores(batches, model, spans: bool, columns: int):
    """Each batch's first ``columns`` columns, then its marginals' two figures, score and spans. The text is column 1."""
    model = model.value
    store = Potentials(model.crf)
    for batch in batches:
        data, offsets = string_buffer(batch.column(1))
        for a, b in slices(np.diff(offsets), 1 << 19):
            part, base = batch.slice(a, b - a), offsets[a]
            here = data[base : offsets[b]]
            p, at, start, end = _marginals(here, offsets[a : b + 1] - base, store, True)
            top, none = np.zeros(b - a), np.zeros(b - a)
            if len(some := np.flatnonzero(np.diff(at))):
                top[some] = np.maximum.reduceat(p, at[some])
                none[some] = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), at[some])
            top, any_ = _logit(top), _logit(-np.expm1(none))
            found: list[list] = [[] for _ in range(b - a)]
            for k in np.flatnonzero(p >= 0.5).tolist() if spans else ():
                i = int(np.searchsorted(at, k, side="right")) - 1
                before = here[offsets[a + i] - base : start[k]].tobytes().decode()
                found[i].append({"start": len(before), "end": len(before) + len(here[start[k] : end[k]].tobytes().decode())})
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(columns) if i != 1), pa.array(top), pa.array(any_), pa.array(model.score(top, any_)), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=[*(part.schema.names[i] for i in range(columns) if i != 1), "top", "any", "score", "spans"],
            )


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 3000, max_clean: int = 5000, max_chains: int = 4000, least: int = 3, folds: Column | None = None, again: int = 0) -> ToxicModel:
    """Fit on documents (doc_id, text) with labels (doc_id, toxic). ``folds``: a condition on doc_id that training rows meet; ``again``: how often tokens are tagged anew."""
    spark = small_batches(docs).sparkSession
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)")
    if folds is not None:
        known = known.where(folds)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(1, max_toxic).unionByName(pick(0, max_clean))
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    sample = cut_lineage(sample)
    lexicon = frozenset(word_evidence(sample, least))
    if not lexicon:
        return ToxicModel(Crf(2, features, neighbour, (-1, 1)))
    chains = sample.mapInArrow(lambda it: _stretches(it, lexicon), "doc_id long, start long, tokens array<string>, tags array<int>, kind int")
    order = [F.xxhash64("doc_id", "start"), "doc_id", "start"]
    taken = [r for kind, n in ((2, max_chains // 2), (1, max_chains // 8 if again else 0), (0, max_chains // 2)) if n for r in chains.where(F.col("kind") == kind).orderBy(*order).limit(n).collect()]
    crf = Crf(2, features, neighbour, (-1, 1)).fit([(r["tokens"], r["tags"], []) for r in taken])
    rows = [(r["doc_id"], r["kind"], r["tokens"], r["tags"]) for r in taken]
    for _ in range(again):
        tags = retagged(crf, rows)
        crf.fit([(tokens, y, []) for (_, _, tokens, _), y in zip(rows, tags, strict=True)], rounds=20, warm=True)
    model = ToxicModel(crf)
    shared = spark.sparkContext.broadcast(model)
    rows = sample.mapInArrow(lambda it: _scores(it, shared, False, 3), "doc_id long, toxic int, top double, any double, score double, spans array<struct<start:long,end:long>>").select("toxic", "top", "any").collect()  # a row a document of the sample
    model.weights = _logistic(np.array([[1.0, r["top"], r["any"]] for r in rows]), np.array([r["toxic"] for r in rows], float))
    return ToxicModel(crf, model.weights)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method, classes weighted equally."""
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hess, x.T @ (weight * (p - y)) + ridge * w)
    return tuple(float(v) if math.isfinite(v) else 0.0 for v in w)


def score(docs: DataFrame, model: ToxicModel, spans: bool = True) -> DataFrame:
    """doc_id, score (0 to 1), spans (start and end, code points) of every row of ``docs``."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _scores(it, shared, spans, 2), "doc_id long, top double, any double, score double, spans array<struct<start:long,end:long>>").select("doc_id", "score", "spans")


def remove_toxic(docs: DataFrame, model: ToxicModel, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns as they are, in one pass over them."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def keep(batches):
        for batch in batches:
            view = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], names=["i", "text"])
            good = [i for out in _scores([view], shared, False, 2) for i, s in zip(out.column(0).to_pylist(), out.column(3).to_pylist(), strict=True) if s < limit]
            yield batch.take(pa.array(good, pa.int64()))

    return docs.mapInArrow(keep, docs.schema)
