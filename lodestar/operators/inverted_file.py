"""RET18: approximate neighbours by an inverted file with product-quantised residuals.

Rows belong to the nearest of some coarse centroids; what is left of a vector is cut into parts, each
stored as the number of its nearest code, a byte. A query looks at the lists whose centroids have the largest inner products with it, adds
up table entries for their codes, and the ``refine`` best rows are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

CODES = 256


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)


def _means(x: np.ndarray, n: int, rounds: int, r: np.random.Generator) -> np.ndarray:
    """n centres by Lloyd's rounds from different rows; a centre that loses all its rows stays where it was."""
    x_ = np.unique(x, axis=0)
    centres = x_[r.permutation(len(x_))[:n]].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        size = np.bincount(at, minlength=len(centres))
        for j in range(x.shape[1]):
            total = np.bincount(at, x[:, j], len(centres))
            centres[size > 0, j] = total[size > 0] / size[size > 0]
    return centres


class Quantiser:
    """Coarse centroids and a code book for each part of the residuals."""

    def __init__(self, x: np.ndarray, lists: int, parts: int, rounds: int = 10, seed: int = 7):
        r = np.random.default_rng(seed)
        self.centroids = _means(x, lists, rounds, r)
        self.cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
        left = x - self.centroids[_nearest(x, self.centroids)]
        self.books = [_means(left[:, a:b], CODES, rounds, r) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes (rows x parts) of each row."""
        at = _nearest(x, self.centroids)
        left = x - self.centroids[at]
        return at, np.stack([_nearest(left[:, a:b], book).astype(np.uint8) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)], 1)

    def scores(self, q: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries x rows) with rows of one list."""
        out = np.repeat((q @ self.centroids[list_])[:, None], len(codes), 1)
        for k, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            out += (q[:, a:b] @ self.books[k].T)[:, codes[:, k]]
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)


def _whole(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id and x of rows whose vectors have all their components, finite; of those with one key the first by vector."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    t = rows.select(F.col(key).alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return t.groupBy("id").agg(F.min("x").alias("x"))


def fit(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", lists: int = 64, parts: int = 32, sample: int = 16_384) -> Quantiser | None:
    """A quantiser learnt from at most ``sample`` rows, those first by a hash of the key; None without rows."""
    taken = _whole(rows, key, vector).orderBy(F.xxhash64("id"), "id").limit(sample).select("x").toArrow()
    return Quantiser(_vectors(taken.column("x").combine_chunks()), lists, parts) if len(taken) else None


def index(rows: DataFrame, model: Quantiser, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, list, code of every row: what is stored and searched."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # lists x d numbers, and 256 x d

    def run(batches):
        for batch in batches:
            if len(batch):
                at, codes = shared.value.encode(_vectors(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "list", "code"])

    return _whole(rows, key, vector).mapInArrow(run, "id long, list int, code binary")


def candidates(queries: DataFrame, stored: DataFrame, model: Quantiser, refine: int, probes: int, key: str = "vec_id", vector: str = "embedding", block: int = 65_536, group: int = 512) -> DataFrame:
    """query_id, id: the ``refine`` rows of each query's ``probes`` lists that look best, its own id left out.

    Rows are dealt to blocks of about ``block``, queries to groups of about ``group``. A task takes one of each, looks at all lists
    there and hands on ``refine`` rows a query, so that what it holds does not grow with the tables.
    """
    shared = queries.sparkSession.sparkContext.broadcast(model)

    def probe(batches):
        for batch in batches:
            if len(batch):
                centres = shared.value.centroids
                near = np.argsort(-(_vectors(batch.column(1)) @ centres.T), 1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.tolist(), pa.list_(pa.int32()))], names=["query_id", "x", "lists"])

    groups, blocks = max(1, -(-queries.count() // group)), max(1, -(-stored.count() // block))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = _whole(queries, key, vector).mapInArrow(probe, "query_id long, x array<double>, lists array<int>")
    q = asked.select("query_id", "x", "lists", F.lit(None).cast("int").alias("list"), F.lit(None).cast("binary").alias("code"), own("query_id", groups).alias("qb"), every(blocks).alias("rb"))
    r = stored.select(F.col("id").alias("query_id"), F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("array<int>").alias("lists"), "list", "code", every(groups).alias("qb"), own("id", blocks).alias("rb"))

    def best(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        held = part.column("code").is_valid()
        rows, asks = part.filter(held), part.filter(pc.invert(held))
        if not len(rows) or not len(asks):
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "guess": pa.array([], pa.float64())})
        ids, q_ids, at = rows.column("query_id").to_numpy(), asks.column("query_id").to_numpy(), rows.column("list").to_numpy()
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        x, near = _vectors(asks.column("x").combine_chunks()), np.stack(asks.column("lists").combine_chunks().to_numpy(zero_copy_only=False))
        found, guess = np.zeros((len(q_ids), refine), np.int64), np.full((len(q_ids), refine), -np.inf)
        for list_ in np.unique(at):
            mine, here = np.flatnonzero((near == list_).any(1)), np.flatnonzero(at == list_)
            for first in range(0, len(here) if len(mine) else 0, 4096):
                some = here[first : first + 4096]
                s = shared.value.scores(x[mine], list_, codes[some])
                s[q_ids[mine][:, None] == ids[some]] = -np.inf
                both, names = np.concatenate([guess[mine], s], 1), np.concatenate([found[mine], np.tile(ids[some], (len(mine), 1))], 1)
                top = np.argpartition(-both, refine - 1, 1)[:, :refine]
                guess[mine], found[mine] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        keep = np.isfinite(guess)
        return pa.table({"query_id": np.repeat(q_ids, keep.sum(1)), "id": found[keep], "guess": guess[keep]})

    dealt = q.unionByName(r).repartition(min(groups * blocks, 2000), "qb", "rb")  # a number that is given stays, however small the rows are
    found = dealt.groupBy("qb", "rb").applyInArrow(best, "query_id long, id long, guess double")
    w = Window.partitionBy("query_id").orderBy(F.desc("guess"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= refine).select("query_id", "id")


def approximate_knn(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", lists: int = 64, probes: int = 48, refine: int | None = None, parts: int = 32) -> DataFrame:
    """RET18: query_id, rank, key, score: the k best of ``refine`` (20 k unless said) exactly scored candidates. Vectors that are null or not finite take no part."""
    model = fit(rows, key, vector, lists, parts)
    if model is None:
        return queries.limit(0).select(F.col(key).alias("query_id"), F.lit(1).alias("rank"), key, F.lit(0.0).alias("score"))
    pairs = candidates(queries, settled(index(rows, model, key, vector)), model, refine or 20 * k, probes, key, vector)
    both = pairs.join(_whole(rows, key, vector), "id").join(_whole(queries, key, vector).select(F.col("id").alias("query_id"), F.col("x").alias("y")), "query_id")
    score = F.round(F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v), 6)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return both.select("query_id", "id", score.alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
