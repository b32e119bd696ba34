"""Exact top-k by inner product over norm-sorted vectors (operator 4).

Vectors are made integers, component by component, so scores are exact. Of equal
vectors the k + 1 smallest ids take part, for no other can be a result. They lie in
bands of falling length, and each band in chunks sorted by length. Every query meets
one chunk of the longest vectors first, which gives it a threshold. Then a block of
queries meets the chunks of those bands only whose longest vector could still reach
a threshold (Cauchy-Schwarz). Within a chunk, vectors go by falling length. Partial
sums over the leading coordinates after an SVD rotation, plus the product of what is
left of both lengths, bound the score; only pairs whose bound reaches the threshold
are scored in full.

Both sides are met block by block, so no task holds more than one block of queries
and one chunk at a time, and each chunk is a key of its own. What the driver sees is
one chunk, at most ``max_bands`` band edges and lengths, and sums of d x d Gram
matrices, about as many as the square root of the number of partitions.

Vectors that are null or hold a null or non-finite component, and rows with a
null id, take no part; with no others, or no query, the result is empty. Vectors of
unlike length count as padded with zeros. Rows with a query's own id are never its
results. Equal scores go by the smaller id; repeated rows of one id count once. An id
with different vectors, as a query or as a result, has the best score of them.
Components and scores beyond the range of a long count as its ends. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, pack, shuffle_partitions, unpack

STEP = 1024  # vectors of a chunk that are bounded at once
LOW = np.iinfo(np.int64).min  # under every score


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.int64)


def _gram(batches, d: int):
    """The partition's Gram matrix, as one row."""
    total = np.zeros((d, d))
    for batch in batches:
        x = _matrix(batch.column(0), d).astype(float)
        total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])


def _gram_sum(part: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, float) for x in part.column("v").to_pylist())
    return pa.table({"v": pa.array([total.tobytes()], pa.binary())})


def _lengths(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return np.sqrt((x * x).sum(1))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices."""
    out = np.einsum("ij,ij->i", q, x)  # modulo 2 ** 64, so right wherever the true value is a long
    for i in np.flatnonzero(np.abs(np.einsum("ij,ij->i", q.astype(float), x.astype(float))) > 2.0**62).tolist():
        out[i] = min(max(sum(map(int.__mul__, q[i].tolist(), x[i].tolist())), LOW + 1), -(LOW + 1))
    return out


def _chunks(part: pa.Table, d: int, size: int) -> pa.Table:
    ids, x = part.column("id").to_numpy(), _matrix(part.column("v"), d)
    order = np.lexsort((ids, -_lengths(x)))
    blobs = [pack(ids[r], x[r].reshape(-1)) for r in np.split(order, range(size, len(order), size))]
    return pa.table({"band": pa.array([part.column("band")[0].as_py()] * len(blobs), pa.int64()), "piece": pa.array([part.column("piece")[0].as_py()] * len(blobs), pa.int64()), "chunk": pa.array(blobs, pa.binary())})


class _Best:
    """The k best ids of each query so far, each once."""

    def __init__(self, n: int, k: int, threshold: np.ndarray, repeats: bool):
        """repeats: an id may come more than once."""
        self.repeats = repeats
        self.score, self.id, self.threshold, self.k = np.full((n, k), LOW), np.full((n, k), np.iinfo(np.int64).max), threshold.copy(), k

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Pairs (query, vector) with their scores."""
        if self.repeats:
            order = np.lexsort((~scores, ids, q))
            q, ids, scores = q[order], ids[order], scores[order]
            new = np.append(True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]))
            q, ids, scores = q[new], ids[new], scores[new]
        order = np.lexsort((ids, ~scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        q, ids, scores, place = q[keep], ids[keep], scores[keep], (np.arange(len(q)) - first)[keep]
        rows = np.unique(q)
        s, i = np.full((len(rows), 2 * self.k), LOW), np.full((len(rows), 2 * self.k), np.iinfo(np.int64).max)
        s[:, : self.k], i[:, : self.k] = self.score[rows], self.id[rows]
        at = np.searchsorted(rows, q)
        s[at, self.k + place], i[at, self.k + place] = scores, ids
        if self.repeats:
            by_id = np.lexsort((~s, i), axis=1)
            s, i = np.take_along_axis(s, by_id, 1), np.take_along_axis(i, by_id, 1)
            again = np.zeros(i.shape, bool)
            again[:, 1:] = i[:, 1:] == i[:, :-1]
            s[again], i[again] = LOW, np.iinfo(np.int64).max
        best = np.lexsort((i, ~s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
        self.threshold[rows] = np.maximum(self.threshold[rows], self.score[rows, -1])


def _search(queries: tuple, chunk: tuple, rotation: np.ndarray, k: int, d: int) -> _Best:
    qid, q, threshold = queries
    ids, x = chunk
    best = _Best(len(qid), k, threshold, len(np.unique(ids)) < len(ids))
    stages = sorted({max(1, d // 4), max(1, d // 2)})
    qr, q_norm = q @ rotation, _lengths(q)
    rest_q = np.sqrt(np.maximum(np.cumsum((qr * qr)[:, ::-1], 1)[:, ::-1], 0))
    for at in range(0, len(ids), STEP):
        part, part_ids = x[at : at + STEP], ids[at : at + STEP]
        norm = _lengths(part)
        slack = 1e-9 * q_norm * norm[0] + 1e-6
        live = np.flatnonzero(q_norm * norm[0] + slack >= best.threshold)
        if not len(live):
            break  # the vectors after this one are no longer
        xr = part @ rotation
        rest_x = np.sqrt(np.maximum(np.cumsum((xr * xr)[:, ::-1], 1)[:, ::-1], 0))
        limit = (best.threshold[live] - slack[live])[:, None]
        rows, cols = np.nonzero((q_norm[live][:, None] * norm >= limit) & (qid[live][:, None] != part_ids))
        partial, done = np.zeros(len(rows)), 0
        for stage in stages:
            sums = qr[live, done:stage] @ xr[:, done:stage].T
            partial += sums[rows, cols]
            left = rest_q[live, stage][rows] * rest_x[:, stage][cols] if stage < d else 0
            ok = partial + left >= limit[rows, 0]
            rows, cols, partial, done = rows[ok], cols[ok], partial[ok], stage
        for a in range(0, len(rows), 1 << 16):
            r, c = live[rows[a : a + (1 << 16)]], cols[a : a + (1 << 16)]
            exact = _scores(q[r], part[c])
            ok = exact >= best.threshold[r]
            if ok.any():
                best.add(r[ok], part_ids[c[ok]], exact[ok])
    return best


def _meet(batches, rotation, k: int, d: int):
    """The best pairs of each row's query block and chunk."""
    for batch in batches:
        for queries, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            qid, q, threshold = unpack(queries)
            ids, x = unpack(chunk)
            best = _search((qid, q.reshape(-1, d), threshold), (ids, x.reshape(-1, d)), rotation, k, d)
            hit = best.id < np.iinfo(np.int64).max
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, hit.sum(1))), pa.array(best.id[hit]), pa.array(best.score[hit])], names=["query_id", "vec_id", "score"])


def _query_blocks(part: pa.Table, lead: bytes, rotation: np.ndarray, k: int, d: int, tops: np.ndarray) -> pa.Table:
    """A query block with its thresholds, for every band that can still matter to it."""
    qid, q = part.column("id").to_numpy(), _matrix(part.column("v"), d)
    order = np.argsort(qid, kind="stable")
    qid, q = qid[order], q[order]
    ids, x = unpack(lead)
    low = _search((qid, q, np.full(len(qid), LOW)), (ids, x.reshape(-1, d)), rotation, k, d).threshold
    reach = [b for b, top in enumerate(tops.tolist()) if (_lengths(q) * top * (1 + 1e-9) + 1e-6 >= low).any()]
    return pa.table({"band": pa.array(reach, pa.int64()), "queries": pa.array([pack(qid, q.reshape(-1), low)] * len(reach), pa.binary())})


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, chunk: int = 4096, block: int = 1024, max_bands: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query over all other rows.

    vectors: vec_id long, embedding array of numbers; is_query: which rows are
    queries; scale: a component x counts as floor(scale * x).
    """
    value = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(good).select(F.col("vec_id").alias("id"), value.alias("v"), is_query.alias("q"))
    rows = rows.groupBy("id", "v").agg(F.bool_or("q").alias("q"))  # equal rows would fill the k places of a query
    rows = cut_lineage(rows)
    d, asked = rows.agg(F.max(F.size("v")), F.count_if("q")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not asked:
        return vectors.sparkSession.createDataFrame([], schema)
    padded = F.when(F.size("v") == d, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("v"))))
    rows = rows.select("id", padded.alias("v"), "q")
    among = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    clean = cut_lineage(rows.select("id", "v").withColumn("among", among).where(F.col("among") <= k + 1).select("id", "v", length.alias("norm")))
    n = clean.count()

    parts = clean.rdd.getNumPartitions()
    sums = clean.select("v").mapInArrow(lambda it: _gram(it, d), "part long, v binary").groupBy(F.pmod("part", F.lit(max(1, int(parts**0.5))))).applyInArrow(_gram_sum, "v binary").collect()
    gram = sum((np.frombuffer(r["v"], float) for r in sums), np.zeros(d * d))
    _, rotation = np.linalg.eigh(gram.reshape(d, d))
    rotation = np.ascontiguousarray(rotation[:, ::-1])

    bands = max(1, min(max_bands, -(-n // chunk)))
    edges = clean.stat.approxQuantile("norm", [i / bands for i in range(1, bands)], 0.001) if bands > 1 else []
    edges = sorted(set(edges), reverse=True)
    band = F.aggregate(F.array(*[F.lit(e) for e in edges]), F.lit(0), lambda s, e: s + (F.col("norm") < e).cast("int")) if edges else F.lit(0)
    placed = clean.withColumn("band", band.cast("long"))
    tops = np.zeros(len(edges) + 1)
    for r in placed.groupBy("band").agg(F.max("norm").alias("m")).collect():  # at most max_bands rows
        tops[r["band"]] = r["m"]
    # a band is dealt out by id too, so that one with many equal lengths is not one task's
    pieces = max(1, -(-n // (bands * chunk)) * 2)
    cells = len(tops) * pieces
    chunks = placed.withColumn("piece", F.pmod(F.xxhash64("id", "v"), F.lit(pieces))).select("band", "piece", "id", "v").groupBy("band", "piece").applyInArrow(lambda t: _chunks(t, d, chunk), "band long, piece long, chunk binary")
    chunks = cut_lineage(chunks)
    lead = chunks.orderBy("band", "piece", F.xxhash64("chunk")).select("chunk").first()["chunk"]  # the longest vectors, of at most ``chunk``
    blocks = max(1, -(-asked // block))
    queries = rows.where("q").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))).select("block", "id", "v").groupBy("block").applyInArrow(lambda t: _query_blocks(t, lead, rotation, k, d, tops), "band long, queries binary")
    spread = cut_lineage(queries).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))))
    tasks = max(shuffle_partitions(vectors.sparkSession), 2 * cells)
    met = spread.repartition(tasks, "band", "piece").join(chunks.repartition(tasks, "band", "piece"), ["band", "piece"]).select("queries", "chunk")
    found = met.mapInArrow(lambda it: _meet(it, rotation, k, d), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id's vectors can lie in several chunks
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
