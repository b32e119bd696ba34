"""RET3 to RET7, JN11: ranks over all rows of a scope, from the rows that have a score.

A row without a score shares nothing with the question. Its rank is the number of rows with a positive score, plus its
place among the scope's ids, less the positive rows before it there. So only scored rows are ranked, and of the others as many are made
as the caller wants to see, the least ids first: they come from the gaps between the scored rows' places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import row_numbers


FEW = 1_000_000  # keys that one window numbers; more go by ranges


def id_order(rows: DataFrame, scope: list[str], key: str) -> DataFrame:
    """scope, key, place (from 1 by key): for all questions of the scope."""
    keys = rows.select(*scope, key)
    if keys.limit(FEW + 1).count() <= FEW:
        return keys.withColumn("place", F.row_number().over(Window.partitionBy(*scope).orderBy(key)).cast("long"))
    return row_numbers(keys, list(scope), [key], "place")


def _gaps(keyed: DataFrame, asked: DataFrame, sizes: DataFrame, scope: list[str], owner: str, limit: int | Column | None) -> DataFrame:
    """scope, owner, place of the first ``limit`` places (all, if None) that no row of ``keyed`` (scope, owner, place) has.

    A mark before all places knows the scope's size and the limit; after each row comes a gap up to the next.
    """
    most = (limit if isinstance(limit, Column) else F.lit(limit)).cast("long").alias("most")
    marks = asked.select(*scope, owner, most).distinct().join(sizes, list(scope)).select(*scope, owner, F.lit(0).cast("long").alias("place"), "size", "most")  # sizes: a row a scope
    none = F.lit(None).cast("long")
    w = Window.partitionBy(*scope, owner).orderBy("place")
    known = lambda name: F.first(name).over(w)
    n = F.coalesce(F.lead("place").over(w), known("size") + 1) - F.col("place") - 1
    gaps = marks.unionByName(keyed.select(*scope, owner, "place", none.alias("size"), none.alias("most"))).select(*scope, owner, "place", n.alias("n"), (F.col("place") - F.row_number().over(w) + 1).alias("had"), known("most").alias("most"))
    take = F.when(F.col("most").isNull(), F.col("n")).otherwise(F.least(F.col("n"), F.col("most") - F.col("had")))
    return gaps.withColumn("take", take).where("take > 0").select(*scope, owner, F.explode(F.sequence(F.col("place") + 1, F.col("place") + F.col("take"))).alias("place"))


def with_unscored(scored: DataFrame, order: DataFrame, asked: DataFrame, scope: list[str], query: str, key: str, values: list[str], limit: int | Column | None, owner: str | None = None) -> DataFrame:
    """``scored`` (scope, query, key, values) with ``place``, and rows of the scope that have no score, with 0 for all ``values``: the first ``limit`` of each query by key, or all.

    owner: queries with one owner get the same rows, those that any of them has a score for included. asked: scope, query (and owner);
    ``limit`` may be a column of it, the same for all queries of an owner, null for all rows.
    """
    placed = scored.join(order, [*scope, key])
    sizes = order.groupBy(*scope).agg(F.max("place").alias("size"))
    if owner is None:
        gaps = _gaps(placed.select(*scope, query, "place"), asked, sizes, scope, query, limit)
        more = gaps.join(order, [*scope, "place"]).select(*scope, query, key, "place", *[F.lit(0.0).alias(v) for v in values])
        return placed.select(*scope, query, key, "place", *values).unionByName(more)
    keyed = placed.join(asked.select(*scope, query, owner), [*scope, query]).select(*scope, owner, key, "place").distinct()
    gaps = _gaps(keyed.drop(key), asked, sizes, scope, owner, limit).join(order, [*scope, "place"])
    each = keyed.unionByName(gaps.select(*scope, owner, key, "place")).join(asked.select(*scope, query, owner), [*scope, owner])
    return each.join(placed.drop("place"), [*scope, query, key], "left").fillna(0.0, values).select(*scope, query, owner, key, "place", *values)


def counted_rank(score: str, query: list[str], places: int = 9) -> Column:
    """The rank of each row among all rows of the scope, by the score rounded to ``places`` (0 at least), then by place; rows of ``with_unscored``."""
    value = F.round(F.col(score), places)
    w = Window.partitionBy(*query)
    positive = (value > 0).cast("int")
    among = F.row_number().over(w.orderBy(F.desc(value), "place"))
    before = F.sum(positive).over(w.orderBy("place"))
    return F.when(value > 0, among).otherwise(F.sum(positive).over(w) + F.col("place") - before)
