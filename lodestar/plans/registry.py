"""Where the queries and their DuckDB SQL are registered."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens_sql(x: str) -> str:
    """FN1 in DuckDB."""
    runs = f"regexp_extract_all(lower({x}), '[一-鿿]+')"
    grams = f"flatten([list_concat([r[i] FOR i IN range(1, length(r) + 1)], [r[i:i + 1] FOR i IN range(1, length(r))]) FOR r IN {runs}])"
    return f"list_concat(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9_+\\-]+'), {grams})"
