"""Connected components of an edge table as Spark joins and aggregations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _local_stars(batches):
    """The edges of a partition as stars: each node with the least one that these edges connect it to."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])


def _settled(stars: DataFrame) -> bool:
    """Whether each node has one neighbour only, which has none itself."""
    ends = stars.select(F.col("a").alias("id"), F.col("b").alias("to")).union(stars.select(F.col("b").alias("id"), F.lit(None).cast("long").alias("to")))
    return ends.groupBy("id").agg(F.min("to").alias("low"), F.max("to").alias("high"), (F.count("*") > F.count("to")).alias("root")).where("low < high or (root and low is not null)").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every node of ``edges`` (a long, b long); component is the smallest id reachable.

    Each partition's edges become stars; then alternating large-star and small-star
    steps (Kiveris et al., 2014), each one aggregation and one join on the node,
    until every node hangs on the least of its component: a logarithmic number
    of steps in practice. Lineage is cut each round.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = both.join(least, "a")
        if large:  # larger neighbours go to the smallest
            out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # the node and its smaller neighbours go to the smallest
            out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    current = cut_lineage(edges.select("a", "b").mapInArrow(_local_stars, "a long, b long").distinct())
    for _ in range(rounds):
        if _settled(current):
            break
        current = cut_lineage(star(star(current, True), False))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
