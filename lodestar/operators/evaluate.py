"""Ranking metrics, coverage, gates, costs, leakage and near-duplicate audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import answer_matches
from ..session import settled
from .ranks import row_numbers


def first_ranks(ranked: DataFrame, gold: DataFrame, query: str, source: str) -> DataFrame:
    """The rank of each query's first expected source; null if none is there. gold: query, category, expected_sources."""
    hit = ranked.join(gold.select(query, F.explode("expected_sources").alias(source)), [query, source]).groupBy(query).agg(F.min("rank").alias("first_rank"))
    return gold.join(hit, query, "left")


def ranking_metrics(ranks: DataFrame, by_category: bool = True) -> DataFrame:
    """EV1, EV2, AG16: Hit@1/3/5, MRR and nDCG, overall (category null) and by category in one pass."""
    r = F.col("first_rank")
    hit = lambda k: F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 4)
    metrics = [F.count("*").alias("n"), hit(1).alias("hit1"), hit(3).alias("hit3"), hit(5).alias("hit5"), F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 4).alias("mrr"), F.round(F.avg(F.coalesce(1.0 / F.log2(r + 1.0), F.lit(0.0))), 4).alias("ndcg")]
    return ranks.rollup("category").agg(*metrics) if by_category else ranks.agg(*metrics)


def coverage(found: DataFrame, gold: DataFrame, query: str) -> DataFrame:
    """EV3, ST2: recall and full coverage at 3 and 5, overall and by category. found: query, rank, source, rank 5 at most."""
    lists = found.groupBy(query).agg(F.collect_set(F.when(F.col("rank") <= 3, F.col("source"))).alias("s3"), F.collect_set(F.when(F.col("rank") <= 5, F.col("source"))).alias("s5"))
    both = gold.join(lists, query, "left")
    out = []
    for k in (3, 5):
        have = F.coalesce(f"s{k}", F.array().cast("array<string>"))
        out += [F.round(F.avg(F.size(F.array_intersect("expected_sources", have)) / F.size("expected_sources")), 4).alias(f"recall{k}"), F.round(F.avg((F.size(F.array_except("expected_sources", have)) == 0).cast("double")), 4).alias(f"full{k}")]
    return both.rollup("category").agg(F.count("*").alias("n"), *out)


def list_recall(found: DataFrame, truth: DataFrame, query: str, key: str) -> DataFrame:
    """EV7: how much of each query's true list another list has."""
    hit = truth.join(found.select(query, key, F.lit(1).alias("h")), [query, key], "left")
    return hit.groupBy(query).agg(F.round(F.avg(F.coalesce("h", F.lit(0))), 4).alias("recall"))


def answer_evaluation(answers: DataFrame, gold: DataFrame, query: str) -> DataFrame:
    """EV4: whether the source is in the top 5, is cited, and abstention is as expected. answers: query, sources, cited, abstained."""
    a = gold.join(answers, query, "left")
    return a.select(query, F.coalesce(F.array_contains("sources", F.col("expected")), F.lit(False)).alias("in_top5"), F.coalesce(F.array_contains("cited", F.col("expected")), F.lit(False)).alias("is_cited"), (F.coalesce("abstained", F.lit(True)) == F.col("expected_abstain")).alias("abstained_right"))


def gate_confusion(gated: DataFrame, accepted: Column, positive: Column) -> DataFrame:
    """EV5: accept rate on positives, abstain rate on negatives."""
    rate = lambda a, b: F.round(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 4)
    return gated.agg(F.count_if(positive).alias("positives"), rate(positive & accepted, positive).alias("accept_rate"), F.count_if(~positive).alias("negatives"), rate(~positive & ~accepted, ~positive).alias("abstain_rate"))


def calibration(scored: DataFrame, query: str, score: str, positive: str) -> DataFrame:
    """EV6: least and mean score of positives, the mean lead of the winner, and the best negative."""
    top = scored.groupBy(query).agg(F.max(F.when(F.col(positive), F.col(score))).alias("best_positive"), F.max(F.when(~F.col(positive), F.col(score))).alias("best_negative"))
    return top.agg(F.round(F.min("best_positive"), 6).alias("least_positive"), F.round(F.avg("best_positive"), 6).alias("mean_positive"), F.round(F.avg(F.col("best_positive") - F.coalesce("best_negative", F.lit(-1.0))), 6).alias("mean_lead"), F.round(F.max("best_negative"), 6).alias("best_negative"))


def leakage(current: DataFrame, earlier: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """EV8: for each earlier set and column how many different values both have, and whether the set is clean."""
    out = None
    for name, other in earlier.items():
        for c in columns:
            part = current.select(c).intersect(other.select(c)).agg(F.count("*").alias("shared")).select(F.lit(name).alias("earlier"), F.lit(c).alias("facet"), "shared", (F.col("shared") == 0).alias("clean"))
            out = part if out is None else out.unionByName(part)
    return out


FAN = 1024  # digests that one digest of a tree is made of


def tree_digest(rows: DataFrame, by: list[str], order: list[str], leaf: Column) -> DataFrame:
    """EV10: by, rows, sha256 of each group's leaves in order.

    Digests of ``FAN`` leaves in a row are joined to one, and those again until one is left, so that no group is one task's; any
    change, swap or move of a row changes it.
    """
    level = row_numbers(rows.select(*by, *order, F.sha2(leaf, 256).alias("sha256")), by, order, "n")
    sizes = level.groupBy(*by).agg(F.max("n").alias("rows"))
    most = None
    while most is None or most > 1:
        block = F.floor((F.col("n") - 1) / FAN) + 1
        joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sha256"))), lambda x: x["sha256"]), ""), 256)
        if most is not None:  # what is one digest already stays
            joined = F.when(F.count("*") == 1, F.first("sha256")).otherwise(joined)
        level = settled(level.groupBy(*by, block.alias("b")).agg(joined.alias("sha256")).withColumnRenamed("b", "n"))
        most = level.agg(F.max("n")).first()[0] or 1
    return sizes.join(level.drop("n"), by).select(*by, "rows", "sha256")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """EV10: name, sha256 (of the bytes), rows (lines that are not blank) of each file; a file has less than 2 GB."""
    lines = F.filter(F.split(F.decode("content", "UTF-8"), "\n"), lambda x: F.trim(x) != "")
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.size(lines).cast("long").alias("rows"))


def freeze_check(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """EV10: hash and row count of each file against the manifest. Both: name, sha256, rows."""
    m = manifest.select("name", F.col("sha256").alias("want_sha"), F.col("rows").alias("want_rows"))
    return m.join(files, "name", "left").select("name", F.coalesce((F.col("sha256") == F.col("want_sha")) & (F.col("rows") == F.col("want_rows")), F.lit(False)).alias("frozen"))


def leak_probe(results: DataFrame, targets: DataFrame, owners: DataFrame, query: str, key: str) -> DataFrame:
    """EV11: what came back to someone who asked for another tenant's row: results, foreign_rows (of another owner), leaked (targets that came back), targets (that there are at all, or the probe proves nothing).

    results: query, tenant (who asked), key; targets: query, key of rows that another tenant has; owners: key, owner.
    """
    owned = results.join(owners, key).agg(F.count("*").alias("results"), F.count_if(F.col("tenant") != F.col("owner")).alias("foreign_rows"))
    leaked = results.join(targets.select(query, key).distinct(), [query, key], "left_semi").agg(F.count("*").alias("leaked"))
    there = targets.join(owners, key, "left_semi").agg(F.count("*").alias("targets"))
    return owned.crossJoin(leaked).crossJoin(there)  # a row each


def costs(usage: DataFrame, rates: DataFrame, by: list[str]) -> DataFrame:
    """AG14: tokens and cost by price period; cached is at most the prompt; rates are per million."""
    cached = F.least("prompt_tokens", "cached_tokens")
    rows = usage.join(rates, "period").withColumn("cost", ((F.col("prompt_tokens") - cached) * F.col("miss_rate") + cached * F.col("hit_rate") + F.col("completion_tokens") * F.col("output_rate")) / 1_000_000)
    return rows.groupBy(*by).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum(cached).alias("cached_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost"), 8).alias("cost"))


def answer_quality(rows: DataFrame, by: list[str]) -> DataFrame:
    """AG15: correctness over what can be answered, abstention over what cannot."""
    yes = lambda ok, over: F.round(F.avg(F.when(over, ok.cast("double"))), 4)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), yes(F.col("correct"), F.col("answerable")).alias("correct_rate"), yes(F.col("abstained"), ~F.col("answerable")).alias("abstain_rate"))


def document_profile(elements: DataFrame, document: str, modality: str, text: str) -> DataFrame:
    """AG17: elements, characters and a histogram of modalities of each document."""
    counts = elements.groupBy(document, modality).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"))
    return counts.groupBy(document).agg(F.sum("n").alias("elements"), F.sum("chars").alias("characters"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(modality, "n")))).alias("modalities"))


def context_completeness(ranked: DataFrame, query: str, source: Column, context: str, expected: Column) -> DataFrame:
    """EV13: how often the first context, and one of the first five, is of the expected source and contains the expected answer (FN17), and the mean length of contexts. Columns rank and ``context`` in."""
    complete = (source & answer_matches(F.col(context), expected)).cast("int")
    q = ranked.groupBy(query).agg(F.max(F.when(F.col("rank") <= 1, complete)).alias("c1"), F.max(F.when(F.col("rank") <= 5, complete)).alias("c5"), F.avg(F.length(context)).alias("chars"))
    return q.agg(F.round(F.avg("c1"), 4).alias("complete1"), F.round(F.avg("c5"), 4).alias("complete5"), F.round(F.avg("chars"), 4).alias("mean_chars"))


def contract_checks(rows: DataFrame, key: str, category: str, expected: dict[str, int]) -> DataFrame:
    """EV16: each category's count against the contract, and whether keys are unique."""
    want = rows.sparkSession.createDataFrame(list(expected.items()), f"{category} string, want long")
    unique = rows.agg((F.count("*") == F.count_distinct(key)).alias("unique_ids"))
    have = rows.groupBy(category).agg(F.count("*").alias("n"))
    return want.join(have, category, "full").crossJoin(F.broadcast(unique)).select(category, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") == F.col("want"), F.lit(False)).alias("as_agreed"), "unique_ids")  # one row


def turn_accuracies(turns: DataFrame) -> DataFrame:
    """EV17: five accuracies, each over the turns that state it. Columns <name>_ok and <name>_stated."""
    return turns.agg(*[F.round(F.avg(F.when(F.col(f"{n}_stated"), F.col(f"{n}_ok").cast("double"))), 4).alias(n) for n in ("abstain", "reason", "source", "content", "context")])


def rank_rows(rows: DataFrame, query: list[str], score: str, key: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(F.desc(score), key)))
