"""Exports, manifests, and audit and metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import redact_pii


def export_lines(rows: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """SNK1: the chosen columns as JSON lines with sorted keys; bytes as a base64 object. ``write.text`` saves them."""
    kinds = dict(rows.dtypes)
    cells = [F.when(F.col(c).isNotNull(), F.struct(F.base64(c).alias("base64"))).alias(c) if kinds[c] == "binary" else F.col(c) for c in sorted(columns)]
    out = rows.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("value"))
    return out if limit is None else out.limit(limit)


def manifest(rows: DataFrame, language: str, content: str) -> DataFrame:
    """SNK2: record count, languages, and one hash over the rows' hashes that does not depend on their order."""
    return rows.agg(F.count("*").alias("records"), F.sort_array(F.collect_set(language)).alias("languages"), F.sha2(F.sum(F.conv(F.substring(F.sha2(content, 256), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string"), 256).alias("sha256"))


def audit_rows(rows: DataFrame, details: Column) -> DataFrame:
    """SNK3: details serialised and redacted; append them with ``write``."""
    return rows.withColumn("details", redact_pii(F.to_json(details)))


def metric_rows(rows: DataFrame, duration: str = "duration_ms", details: str = "details") -> DataFrame:
    """SNK4: durations 0 at least, to 3 places; details cut at 2,000 characters."""
    return rows.withColumn(duration, F.round(F.greatest(F.lit(0.0), F.col(duration)), 3)).withColumn(details, F.substring(details, 1, 2000))
