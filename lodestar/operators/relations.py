"""Scoped reads, pages, joins and set operations on catalog tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_scope(rows: DataFrame, tenant: str, kb: str | None = None) -> DataFrame:
    """FLT1, SRC14: a tenant's rows, of one knowledge base if given."""
    out = rows.where(F.col("tenant_id") == tenant)
    return out if kb is None else out.where(F.col("knowledge_base_id") == kb)


def split_by_scope(queries: DataFrame, bases: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """FLT2: queries whose knowledge base is the tenant's, and the rejected ones."""
    return queries.join(bases, on, "left_semi"), queries.join(bases, on, "left_anti")


def like(column: str, pattern: str) -> Column:
    """FLT3: case-insensitive containment; ``\\``, ``%`` and ``_`` stand for themselves."""
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.col(column).ilike(f"%{escaped}%")


def since(column: str, as_of: Column, hours: int = 24) -> Column:
    """FLT5: within the last hours before ``as_of``."""
    return F.col(column) >= as_of - F.make_interval(hours=F.lit(hours))


def violations(rules: dict[str, Column]) -> Column:
    """PRJ4: the names of the rules that a row breaks."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in rules.items()]), lambda x: x.isNotNull())


def page(rows: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """CAT1, TK2, WN9: a page by falling key, with the total and whether there is more.

    The total is an aggregate beside the page, not a window over all rows.
    """
    total = rows.agg(F.count("*").alias("total"))
    part = rows.orderBy(F.desc(key)).offset(offset).limit(limit)
    return part.crossJoin(F.broadcast(total)).withColumn("has_more", F.lit(offset + limit) < F.col("total"))  # one row


def with_counts(rows: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """CAT2, JN3, AG1: for each row the number of its rows in each child table, by pre-aggregated left joins."""
    for name, child in children.items():
        rows = rows.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return rows.fillna(0, list(children))


def missing(wanted: DataFrame, have: DataFrame, on: list[str]) -> DataFrame:
    """JN6, JN8, JN9, JN13: what is wanted and not there."""
    return wanted.join(have, on, "left_anti")


def backfill(chunks: DataFrame, parents: DataFrame, children: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """JN7, CHK8: a parent and a child for each chunk of documents that have none. A task holds the different keys of its part; the chunks pass by them unsorted."""
    there = lambda t: t.select(key).distinct().hint("shuffle_hash")
    new_parents, new_children = missing(chunks, there(parents), [key]), missing(chunks, there(children), [key])
    return parents.unionByName(new_parents, allowMissingColumns=True), children.unionByName(new_children, allowMissingColumns=True)


def containing(fragments: DataFrame, rows: DataFrame, fragment: str, text: str, key: str) -> DataFrame:
    """fragment, key of each different non-empty fragment and row whose text contains it.

    A text that contains a fragment contains all its runs of three characters (a shorter fragment is one run), so both
    meet on the one of them that the fewest rows have, and are compared there. Texts are cut only into runs of lengths that
    fragments have, and only runs that some fragment has go on. Keys are unique.
    """
    asked = fragments.where(F.length(fragment) > 0).select(F.col(fragment).alias("_f"), F.least(F.length(fragment), F.lit(3)).alias("_q")).distinct()
    sizes = [r["_q"] for r in asked.select("_q").distinct().collect()]  # three at most
    cut = lambda t, q: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - q + 1), lambda i: F.substring(t, i, F.lit(q))))
    runs = lambda t, q: F.when(F.length(t) >= q, cut(t, q)).otherwise(F.array().cast("array<string>"))
    wanted = asked.select("_f", F.explode(F.when(F.col("_q") < 3, F.array("_f")).otherwise(runs(F.col("_f"), 3))).alias("_g"))
    every = F.flatten(F.array(*[runs(F.col(text), q) for q in sizes])) if sizes else F.array().cast("array<string>")
    held = rows.select(key, F.explode(every).alias("_g")).join(wanted.select("_g").distinct(), "_g", "left_semi")
    common = held.groupBy("_g").agg(F.count("*").alias("_n"))
    rarest = wanted.join(common, "_g", "left").groupBy("_f").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_g")).alias("_r")).where("_r._n > 0").select("_f", "_r._g")
    pairs = rarest.join(held, "_g").select("_f", key).join(rows.select(key, F.col(text).alias("_t")), key)
    return pairs.where(F.col("_t").contains(F.col("_f"))).select(F.col("_f").alias(fragment), key)


def first_match(cases: DataFrame, catalog: DataFrame, fragment: str, url: str, case: str, order: str, strict: bool = True) -> DataFrame:
    """JN14: each case with the first catalog row (by ``order``, unique) whose url contains its fragment. A case without any is an error, or null if not ``strict``. An empty fragment is in every url, a null one in none."""
    best = containing(cases, catalog, fragment, url, order).groupBy(fragment).agg(F.min(order).alias(order))
    first = catalog.agg(F.min(order).alias(order)).select(F.lit("").alias(fragment), order)
    found = cases.select(case, fragment).join(best.unionByName(first), fragment, "left")
    none = F.raise_error(F.concat(F.lit("no catalog row matches case "), F.coalesce(F.col(case).cast("string"), F.lit("null"))))
    return found.select(case, fragment, F.coalesce(order, none.cast(catalog.schema[order].dataType)).alias(order) if strict else order)


def latest(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """WN2, STR4: the latest row of each identity."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def newest(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """TK3: the newest n rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    """ST1, ST4: the union by name, repeated rows once."""
    return reduce(lambda a, b: a.unionByName(b), frames).dropDuplicates()


def overlap_count(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """ST3: how many different values of a column both have."""
    return a.select(on).intersect(b.select(on)).agg(F.count("*").alias("shared"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """EV15: rows on one side only, by side; none if both are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def delete_cascade(doomed: DataFrame, tables: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """JOB6: all tables without the rows of the doomed keys."""
    return {k: t.join(doomed.select(key), key, "left_anti") for k, t in tables.items()}
