"""Batch search: every strategy over many queries and rows within a scope, and kNN."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import hashed_tokens
from ..session import settled
from .counted_ranks import counted_rank, id_order, with_unscored
from .fusion import RRF, first_by, rank_of, rrf, weighted
from .lexical import bm25_among, bm25_and_keyword, bm25_of_lists, bm25_or_keyword, candidates, max_normalised, min_max, token_lists, top_k
from .routing import expand, query_features, route
from .term_index import TermIndex

STRATEGIES = ("keyword", "vector", "weighted", "bm25", "rrf")


def lexical_scores(queries: DataFrame, rows: DataFrame, query: str, key: str, scope: list[str], text: str = "text", query_text: str = "text") -> DataFrame:
    """RET3: bm25, keyword, lexical of each query and row of its scope that share a token. Any other row of the scope has 0 for all three."""
    rows = rows.join(queries.select(*scope).distinct(), list(scope), "left_semi")  # scopes that nobody asks are not read on
    return bm25_or_keyword(bm25_and_keyword(queries, rows, query, key, text, query_text, scope), [*scope, query])


def component_scores(queries: DataFrame, rows: DataFrame, query: str, key: str, scope: list[str], limit: int | Column | None = None, text: str = "text", query_text: str = "text", owner: str | None = None) -> DataFrame:
    """RET7: bm25, keyword, lexical, vector and both ranks of each query and row of its scope that share a token or a bucket; of the others the first ``limit`` by key, or all.

    Vectors are hashed embeddings (EMB2) of the same tokens as the postings, which are found once.
    """
    asked_rows = rows.join(queries.select(*scope).distinct(), list(scope), "left_semi")
    held, asked = settled(token_lists(asked_rows, key, text, scope)), token_lists(queries, query, query_text, scope)
    lexical = bm25_or_keyword(bm25_of_lists(asked, held, query, key, scope), [*scope, query])
    q = hashed_tokens(asked, [*scope, query]).withColumnRenamed("weight", "qw")
    dots = q.join(hashed_tokens(held, [*scope, key]), [*scope, "bucket"]).groupBy(*scope, query, key).agg(F.sum(F.col("qw") * F.col("weight")).alias("vector"))
    both = settled(lexical.join(dots, [*scope, query, key], "full").fillna(0.0, PARTS).withColumn("vector", F.greatest(F.lit(0.0), "vector")))
    out = with_unscored(both, id_order(held, scope, key), queries, scope, query, key, PARTS, limit, owner)
    on = [*scope, query]
    return out.withColumns({"sparse_rank": counted_rank("lexical", on), "dense_rank": counted_rank("vector", on)})


PARTS = ["bm25", "keyword", "lexical", "vector"]


def strategy_scores(components: DataFrame, query: list[str], key: str) -> DataFrame:
    """RET4 to RET6 and RET1 to RET3 side by side: score_<strategy> for each strategy."""
    out = rrf(components, query)
    score = {"keyword": F.col("keyword"), "vector": F.col("vector"), "weighted": weighted(F.col("vector"), F.col("keyword")), "bm25": F.col("lexical"), "rrf": F.col("rrf")}
    return out.withColumns({f"score_{k}": F.round(v, 6) for k, v in score.items()})


def search_batch(scores: DataFrame, query: list[str], key: str, k: int, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """EV14: strategy, rank and score of the k best rows for each query and strategy."""
    stacked = scores.select(*query, key, F.explode(F.create_map(*[x for s in strategies for x in (F.lit(s), F.col(f"score_{s}"))])).alias("strategy", "score"))
    return top_k(stacked, [*query, "strategy"], "score", key, k).select(*query, "strategy", "rank", key, "score")


VARIANTS = 8  # more than a question can have
FEW_ASKED = 2_000  # questions whose tokens and buckets (some 256 each) may be broadcast
LEXICAL, DENSE = ("keyword", "bm25"), ("vector", "weighted", "rrf")


def chosen_strategy(questions: DataFrame, dense_available: bool = True, identifiers: bool = True) -> DataFrame:
    """RET14: ``strategy`` as asked for; where that is auto or null, or there is no such column, as RET13 routes. An unknown one is an error."""
    wanted = F.coalesce(F.col("strategy"), F.lit("auto")) if "strategy" in questions.columns else F.lit("auto")
    known = wanted.isin("auto", "parent_child", *LEXICAL, *DENSE)
    asked = questions.withColumn("wanted", F.when(known, wanted).otherwise(F.raise_error(F.concat(F.lit("unknown retrieval strategy: "), wanted))))
    routed = route(query_features(asked.drop("strategy"), identifiers=identifiers), dense_available)
    return routed.withColumn("strategy", F.when(F.col("wanted") == "auto", F.col("strategy")).otherwise(F.col("wanted"))).drop("wanted")


def routed_search(questions: DataFrame, rows: DataFrame, children: DataFrame, scope: list[str], k: int, model: str, dense_available: bool = True, index: TermIndex | None = None, identifiers: bool = True) -> DataFrame:
    """RET14: each question by the strategy it asks for, or else by RET13's: scope, query_id, strategy, rank, key, score.

    questions: scope, query_id, question, query_transform (RET10), and strategy if wanted; rows: scope, key,
    text, embedding_model; children: scope, key, parent_id, text; index: a stored RET8 of ``rows``, else one is made. Lexical questions
    are scored among their candidates (RET8), with those rows' statistics (RET2).
    Dense ones see only rows whose embedding has the tag ``model`` (EMB3, FLT4).
    parent_child takes the best child of each parent (RET9). ``identifiers`` off: they do not count for the route. A question with several
    variants is fused over all its rows (RET11). Each branch gets its own questions only.

    Rows that share nothing with a question are counted (``counted_ranks``), and made only as far as one can be among the k best: of two such rows
    the one with the lower key is ahead in each variant, so k of them will do, or as many children as k parents can have. Only where reciprocal ranks of
    several variants are fused again are all made, since there such rows come between others.
    """
    on, vid = [*scope, "query_id"], [*scope, "vid"]
    routed = settled(chosen_strategy(questions, dense_available, identifiers).select(*on, "question", "query_transform", "strategy"))
    few = routed.limit(FEW_ASKED + 1).count() <= FEW_ASKED
    routed = F.broadcast(routed) if few else routed
    asked = settled(expand(routed).select(*on, (F.col("query_id") * VARIANTS + F.col("variant")).alias("vid"), "strategy", F.col("variant_text").alias("text")))
    asked = F.broadcast(asked) if few else asked  # what is made of questions alone meets rows without a shuffle
    several = asked.groupBy(*on).agg((F.count("*") > 1).alias("several"), F.first("strategy").alias("strategy"))
    used = {r["strategy"] for r in routed.select("strategy").distinct().collect()}  # six at most
    found = [asked.select(*on, "vid", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("parent_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)]
    if used & set(LEXICAL):
        found.append(_lexical_branch(routed, asked, rows, scope, max(800, 100 * k), index))
    if used & set(DENSE):
        found.append(_dense_branch(asked, rows.where(F.col("embedding_model") == model), scope, k))
    if "parent_child" in used:
        found.append(_parent_branch(asked, children, scope, k))

    fused = reduce(DataFrame.unionByName, found).groupBy(*on, "key").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("raw"), F.max("score").alias("score"), F.max("parent_id").alias("parent_id"))
    scored = fused.join(several, on).withColumn("score", F.when(F.col("several"), F.round(max_normalised(F.col("raw"), on), 6)).otherwise(F.col("score")))
    best = first_by(scored.withColumn("one", F.when(F.col("strategy") == "parent_child", F.col("parent_id")).otherwise(F.col("key"))), on, "one", "score", "key", k)
    return best.select(*on, "strategy", "rank", "key", "score")


_RANKED = ("query_id", "vid", "key", "parent_id", "score", "rank")


def _lexical_branch(routed: DataFrame, asked: DataFrame, rows: DataFrame, scope: list[str], limit: int, index: TermIndex | None) -> DataFrame:
    on, vid = [*scope, "query_id"], [*scope, "vid"]
    terms = routed.where(F.col("strategy").isin(*LEXICAL)).select(*on, F.col("question").alias("text"))
    pairs = index.candidates(terms, "query_id", limit=limit) if index else candidates(terms, rows, "query_id", "key", scope=scope, limit=limit)
    mine = asked.where(F.col("strategy").isin(*LEXICAL))
    own = pairs.select(*on, "key").join(mine.select(*on, "vid"), on)
    among = bm25_among(own.select(*vid, "key"), mine, rows, "vid", "key", scope=scope).join(mine.select(*vid, "query_id", "strategy"), vid)
    among = among.withColumn("score", F.round(F.when(F.col("strategy") == "keyword", F.col("keyword")).otherwise(F.col("lexical")), 6))
    return among.withColumn("rank", rank_of("score", vid, "key")).withColumn("parent_id", F.lit(None).cast("long")).select(*scope, *_RANKED)


def _dense_branch(asked: DataFrame, tagged: DataFrame, scope: list[str], k: int) -> DataFrame:
    on, vid = [*scope, "query_id"], [*scope, "vid"]
    mine = asked.where(F.col("strategy").isin(*DENSE))
    every = mine.groupBy(*on).agg(((F.count("*") > 1) & (F.first("strategy") == "rrf")).alias("every"))
    both = component_scores(mine.join(every, on), tagged, "vid", "key", scope, F.when(~F.col("every"), F.lit(k)), owner="query_id")
    by = strategy_scores(both, vid, "key").join(mine.select(*vid, "strategy"), vid)
    by = by.withColumn("score", F.when(F.col("strategy") == "vector", F.col("score_vector")).when(F.col("strategy") == "weighted", F.col("score_weighted")).otherwise(F.col("score_rrf")))
    rank = F.when(F.col("strategy") == "rrf", rank_of("score", vid, "key")).otherwise(counted_rank("score", vid))
    return by.withColumn("rank", rank).withColumn("parent_id", F.lit(None).cast("long")).select(*scope, *_RANKED)


def _parent_branch(asked: DataFrame, children: DataFrame, scope: list[str], k: int) -> DataFrame:
    vid = [*scope, "vid"]
    mine = asked.where("strategy = 'parent_child'")
    own = settled(children.join(mine.select(*scope).distinct(), list(scope), "left_semi"))
    most = own.groupBy(*scope, "parent_id").count().groupBy(*scope).agg((F.max("count") * k).alias("most"))
    hits = settled(lexical_scores(mine, own, "vid", "key", scope).withColumn("score", F.round("lexical", 6)))
    filled = with_unscored(hits, id_order(own, scope, "key"), mine.join(most, list(scope)), scope, "vid", "key", ["score"], F.col("most"), owner="query_id")
    return filled.join(own.select(*scope, "key", "parent_id"), [*scope, "key"]).withColumn("rank", counted_rank("score", vid)).select(*scope, *_RANKED)


def parent_child(child_scores: DataFrame, children: DataFrame, parents: DataFrame, query: list[str], k: int, score: str = "score") -> DataFrame:
    """RET9: the best child of each parent, then the k best parents, with the parent's text. children: chunk_id, parent_id; parents: parent_id, parent_text."""
    hits = first_by(child_scores.join(children.select("chunk_id", "parent_id"), "chunk_id"), query, "parent_id", score, "chunk_id", k)
    return hits.join(parents.select("parent_id", "parent_text"), "parent_id")


def visual_search(rows: DataFrame, query: list[str], key: str, k: int, ocr_weight: float = 0.45, image_weight: float = 0.55, strategy: str = "hybrid") -> DataFrame:
    """RET15, RET16: fusion of OCR and image scores, each scaled within the query. Columns ocr (raw BM25) and image (similarity, null without a vector) in."""
    scaled = rows.withColumn("ocr_score", min_max(F.col("ocr"), query)).withColumn("image_scaled", min_max(F.coalesce("image", F.lit(0.0)), query))
    image = F.when(F.col("image").isNotNull(), F.col("image_scaled"))
    score = {"ocr": F.col("ocr_score"), "image": F.coalesce(image, F.lit(0.0)), "hybrid": ocr_weight * F.col("ocr_score") + image_weight * F.coalesce(image, F.lit(0.0))}[strategy]
    if strategy == "image":
        some = F.count("image").over(Window.partitionBy(*query))
        score = F.when(some > 0, score).otherwise(F.raise_error(F.lit("image search needs image vectors")))
    return top_k(scaled.withColumn("score", F.round(score, 6)), query, "score", key, k)


QUERY_BYTES = 64 << 20  # vectors of queries that go to all tasks


def _best_of(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query (by number) the k rows with the highest rounded scores, equal ones by id."""
    order = np.lexsort((ids, -np.round(score, 6), at))
    at, ids, score = at[order], ids[order], score[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], ids[keep], score[keep]


def _knn_by_scan(asked: pa.Table, rows: DataFrame, k: int, group: str, key: str, vector: str) -> DataFrame:
    """Each task multiplies what it reads with the queries of the same group and keeps the k best of each query; no row is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast((np.array(asked.column(0).to_pylist(), object), asked.column(1).to_numpy(), np.stack(asked.column(2).to_numpy())))

    def run(batches):
        groups, q_ids, q = shared.value
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            labels, ids = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            x = _stacked(batch.column(2))
            parts = [best]
            for g in set(groups) & set(labels):
                mine, here = np.flatnonzero(groups == g), np.flatnonzero(labels == g)
                s = q[mine] @ x[here].T
                s[q_ids[mine][:, None] == ids[here]] = -np.inf
                rounded = np.round(s, 6)
                if s.shape[1] > k:  # what is under the k-th score is no result
                    rounded[rounded < np.partition(rounded, -k, axis=1)[:, -k, None]] = -np.inf
                at, col = np.nonzero(np.isfinite(rounded))
                parts.append((mine[at], ids[here][col], s[at, col]))
            best = _best_of(*(np.concatenate(p) for p in zip(*parts, strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", key, "score"])

    return rows.select(group, key, F.transform(vector, lambda v: v.cast("double")).alias("x")).where("x is not null").mapInArrow(run, f"query_id long, {key} long, score double")


def _stacked(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix, without a list a row."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def exact_knn(queries: DataFrame, rows: DataFrame, k: int, group: str = "label", key: str = "vec_id", vector: str = "embedding", block: int = 4096, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """RET17: the k rows of each query's group with the largest inner products, (query_id, rank, key, score).

    Queries of up to ``query_bytes`` go to all tasks, which read each row once and shuffle none. With more of them a
    group's rows are dealt to blocks of about ``block``, its queries to blocks of a
    quarter of that, by their counts. A task multiplies one block of either kind and
    keeps the k best of each query. A window merges what tasks have kept.
    """
    asked = queries.select(group, key, F.transform(vector, lambda v: v.cast("double")).alias("x")).where(F.col(group).isNotNull() & F.col("x").isNotNull())
    few = query_bytes // 8 // 64 + 1  # by vectors of 64 numbers; larger ones are counted
    some = asked.limit(few).toArrow()
    if not len(some) or (len(some) < few and some.nbytes <= query_bytes):
        found = _knn_by_scan(some.combine_chunks(), rows, k, group, key, vector) if len(some) else queries.limit(0).select(F.col(key).alias("query_id"), key, F.lit(0.0).alias("score"))
    else:
        found = _knn_by_blocks(queries, rows, k, group, key, vector, block)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", key, F.round("score", 6).alias("score"))


def _knn_by_blocks(queries: DataFrame, rows: DataFrame, k: int, group: str, key: str, vector: str, block: int) -> DataFrame:
    dealt = lambda t, n: F.pmod(F.xxhash64(key), F.ceil(F.col(n) / block if n == "rows" else F.col(n) * 4 / block).cast("int"))
    size = rows.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("rows")).join(queries.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("asked")), "g")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / block if n == "rows" else F.col(n) * 4 / block).cast("int") - 1))
    q = queries.select(key, F.col(group).alias("g"), F.transform(vector, lambda x: x.cast("double")).alias("x")).join(size, "g").select(F.lit(True).alias("asks"), key, "x", "g", dealt(queries, "asked").alias("qb"), every("rows").alias("rb"))
    r = rows.select(key, F.col(group).alias("g"), F.transform(vector, lambda x: x.cast("double")).alias("x")).join(size, "g").select(F.lit(False).alias("asks"), key, "x", "g", every("asked").alias("qb"), dealt(rows, "rows").alias("rb"))

    def best(part: pa.Table) -> pa.Table:
        asks, ids = part.column("asks").to_numpy(zero_copy_only=False), part.column(key).to_numpy()
        x = np.stack(part.column("x").to_numpy(zero_copy_only=False)) if len(ids) else np.zeros((0, 1))
        a, b, x_ids = x[asks], x[~asks], ids[~asks]
        if not len(a) or not len(b):
            return pa.table({"query_id": pa.array([], pa.int64()), key: pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        s = a @ b.T
        s[ids[asks][:, None] == x_ids] = -np.inf
        rounded = np.round(s, 6)
        if s.shape[1] > k:
            rounded[rounded < np.partition(rounded, -k, axis=1)[:, -k, None]] = -np.inf
        at, col = np.nonzero(np.isfinite(rounded))
        at, found, score = _best_of(at, x_ids[col], s[at, col], k)
        return pa.table({"query_id": pa.array(ids[asks][at]), key: pa.array(found), "score": pa.array(score)})

    return q.unionByName(r).groupBy("g", "qb", "rb").applyInArrow(best, f"query_id long, {key} long, score double")


def rerank(ranked: DataFrame, query: list[str], key: str, scorer, depth: int = 10) -> DataFrame:
    """RET20: the first ``depth`` rows ranked anew by ``scorer``, a column or an Arrow UDF's result."""
    w = Window.partitionBy(*query).orderBy(F.desc("rerank_score"), key)
    return ranked.where(F.col("rank") <= depth).withColumn("rerank_score", scorer).withColumn("new_rank", F.row_number().over(w))


