"""Roll-ups of operational logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


EDGES = 128  # blocks of values that a group is cut into


def at_places(rows: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The values at some places of each group in order, exact; ``places``: from the number of values to a place, from 0.

    Equal values are one row with a count. Approximate quantiles cut a group into
    blocks, the blocks' counts tell in which one a place lies, and only that block
    is put in order: no group is one task's, however large.
    """
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    edges = known.groupBy(*by).agg(F.percentile_approx("_v", [i / EDGES for i in range(1, EDGES)], 10_000).alias("_edges"), F.count("*").alias("_n"))
    counts = known.groupBy(*by, "_v").agg(F.count("*").alias("_c")).join(edges, by)
    counts = counts.select(*by, "_v", "_c", "_n", F.size(F.filter("_edges", lambda e: e < F.col("_v"))).alias("_b"))
    blocks = counts.groupBy(*by, "_b", "_n").agg(F.sum("_c").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # EDGES rows at most
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), at(F.col("_n")).cast("long").alias("place")) for k, at in places.items()]))
    found = blocks.withColumn("_before", before).select(*by, "_b", "_before", "_size", wanted.alias("_w")).where((F.col("_w.place") >= F.col("_before")) & (F.col("_w.place") < F.col("_before") + F.col("_size")))
    needed = found.groupBy(*by, "_b").agg(F.first("_before").alias("_before"), F.collect_list("_w").alias("_ws"))  # as many as places
    inside = F.sum("_c").over(Window.partitionBy(*by, "_b").orderBy("_v"))
    last = counts.join(needed, [*by, "_b"]).withColumn("_to", F.col("_before") + inside).select(*by, "_v", F.col("_to"), "_c", F.explode("_ws").alias("_w"))
    hit = last.where((F.col("_w.place") < F.col("_to")) & (F.col("_w.place") >= F.col("_to") - F.col("_c")))
    return hit.groupBy(*by).agg(*[F.max(F.when(F.col("_w.name") == k, F.col("_v"))).alias(k) for k in places])


def nearest_rank(rows: DataFrame, by: list[str], value: str, p: float, name: str, floor: bool = False) -> DataFrame:
    """AG8, AG9: the value at place bround((n - 1) * p), or floor, of each group, to 3 places."""
    at = (lambda n: F.floor((n - 1) * F.lit(p))) if floor else (lambda n: F.bround((n - 1) * F.lit(p)))
    return at_places(rows, by, value, {name: at}).withColumn(name, F.round(name, 3))


def median(rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """The exact median of each group, to 3 places."""
    both = at_places(rows, by, value, {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.ceil((n - 1) / 2)})
    return both.select(*by, F.round((F.col("_low") + F.col("_high")) / 2, 3).alias(name))


def state_counts(jobs: DataFrame, by: list[str], state: str) -> DataFrame:
    """AG2: rows of each state."""
    return jobs.groupBy(*by, state).agg(F.count("*").alias("n"))


def oldest_age(jobs: DataFrame, by: list[str], as_of: Column, queued: Column) -> DataFrame:
    """AG3: the age in seconds of the oldest queued job, 0 at least."""
    return jobs.groupBy(*by).agg(F.min(F.when(queued, F.unix_timestamp("created_at"))).alias("m")).select(*by, F.greatest(F.lit(0), F.unix_timestamp(as_of) - F.coalesce("m", F.unix_timestamp(as_of))).alias("oldest_seconds"))


def request_rollup(requests: DataFrame, by: list[str]) -> DataFrame:
    """AG5: count, errors, abstained, mean and p95 latency, tokens, fallbacks."""
    sums = requests.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.count_if("abstained").alias("abstained"), F.round(F.avg("latency_ms"), 3).alias("mean_ms"), F.sum("token_usage").alias("tokens"), F.count_if(F.col("provider").contains("fallback")).alias("fallbacks"))
    return sums.join(nearest_rank(requests, by, "latency_ms", 0.95, "p95_ms"), by, "left")


def stage_rollup(stages: DataFrame, by: list[str], n: int = 1000) -> DataFrame:
    """AG6, TK3: by stage over each tenant's newest n rows: count, errors, mean and p95."""
    w = Window.partitionBy(*by).orderBy(F.desc("id"))
    recent = stages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    keys = [*by, "stage"]
    sums = recent.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "error").alias("errors"), F.round(F.avg("duration_ms"), 3).alias("mean_ms"))
    return sums.join(nearest_rank(recent, keys, "duration_ms", 0.95, "p95_ms"), keys)


def routing_rollup(audit: DataFrame, by: list[str], n: int = 5000) -> DataFrame:
    """AG7: strategies, reasons and unreadable rows among each tenant's newest n answers and searches, (by, facet, value, n)."""
    w = Window.partitionBy(*by).orderBy(F.desc("id"))
    recent = audit.where(F.col("action").isin("answer", "search")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    parsed = recent.withColumn("_v", F.try_parse_json("details"))
    get = lambda k: F.get_json_object("details", f"$.{k}")
    facets = F.create_map(F.lit("strategy"), F.coalesce(get("retrieval_strategy"), get("strategy")), F.lit("reason"), get("routing_reason"), F.lit("malformed"), F.when(F.col("_v").isNull(), "true"))
    return parsed.select(*by, F.explode(facets).alias("facet", "value")).where("value is not null").groupBy(*by, "facet", "value").agg(F.count("*").alias("n"))


def latency_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """AG10: count, mean, median, p95, p99, min, max."""
    sums = rows.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 3).alias("mean"), F.round(F.min(value), 3).alias("least"), F.round(F.max(value), 3).alias("most"))
    rank = lambda p: lambda n: F.bround((n - 1) * F.lit(p))
    placed = at_places(rows, by, value, {"p95": rank(0.95), "p99": rank(0.99), "_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.ceil((n - 1) / 2)})
    return sums.join(placed.select(*by, F.round((F.col("_low") + F.col("_high")) / 2, 3).alias("median"), F.round("p95", 3).alias("p95"), F.round("p99", 3).alias("p99")), by).select(*by, "n", "mean", "median", "least", "most", "p95", "p99")


def repeated_runs(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """AG11: the median over runs, and how many succeeded and failed."""
    sums = runs.groupBy(*by).agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
    return sums.join(median(runs, by, value), by, "left").select(*by, "median", "succeeded", "failed")
