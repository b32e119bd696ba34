"""Fusion of rankings and first hits by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexical import max_normalised

RRF = 60
VECTOR, KEYWORD = 0.55, 0.45


def rank_of(score: str, query: list[str], key: str, places: int = 9) -> Column:
    """WN1: the place of each row of a query, by the score rounded to ``places``, then by key."""
    return F.row_number().over(Window.partitionBy(*query).orderBy(F.desc(F.round(F.col(score), places)), key))


def weighted(vector: Column, lexical: Column) -> Column:
    """RET5."""
    return VECTOR * vector + KEYWORD * lexical


def rrf(ranked: DataFrame, query: list[str]) -> DataFrame:
    """RET6: reciprocal ranks of the effective lexical score and of the vector score over all candidates of a query, divided by the query's largest; adds ``rrf``. Columns sparse_rank, dense_rank in, those of the first row of each included."""
    raw = 1.0 / (RRF + F.col("sparse_rank")) + 1.0 / (RRF + F.col("dense_rank"))
    return ranked.withColumn("raw_rrf", raw).withColumn("rrf", max_normalised(F.col("raw_rrf"), query)).drop("raw_rrf")


def fuse_variants(ranked: DataFrame, query: list[str], key: str) -> DataFrame:
    """RET11: the sum of reciprocal ranks over a query's variants, divided by the largest. Column rank in; score out."""
    summed = ranked.groupBy(*query, key).agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("raw"))
    return summed.select(*query, key, F.round(max_normalised(F.col("raw"), query), 6).alias("score"))


def first_by(ranked: DataFrame, query: list[str], group: str, score: str, key: str, k: int) -> DataFrame:
    """TK4, TK5: the best row of each group, then the k best of those; rows without a group are left out."""
    best = ranked.where(F.col(group).isNotNull()).withColumn("r", F.row_number().over(Window.partitionBy(*query, group).orderBy(F.desc(score), key))).where("r = 1").drop("r")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(F.desc(score), key))).where(F.col("rank") <= k)


def margin(score: str, query: list[str]) -> Column:
    """WN6: the top score less the best of the rest, which counts as -1 if there is none."""
    top = F.max(score).over(Window.partitionBy(*query))
    later = Window.partitionBy(*query).orderBy("rank").rowsBetween(1, Window.unboundedFollowing)
    return top - F.coalesce(F.max(score).over(later), F.lit(-1.0))
