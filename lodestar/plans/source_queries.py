"""Queries for sources, sinks and the batch replays of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers, sinks
from ..streaming import streams
from .registry import query, table


@query(r"SELECT doc_id, CAST(i - 1 AS INTEGER) AS element_index, b[i] AS text FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM (SELECT doc_id, list_filter([regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '') FOR x IN string_split_regex(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), '\n\n+')], lambda x: x <> '') AS b FROM documents))")
def src1_text_elements(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"))
    return readers.text_elements(d, "doc_id", "text")


@query("SELECT c_custkey, 'c_custkey: ' || c_custkey || ' | c_name: ' || c_name || ' | c_mktsegment: ' || c_mktsegment AS line FROM customer")
def src4_record_lines(spark, sf_dir):
    """SRC3, SRC4: rows as JSON records, then as lines."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("j"))
    return c.select("c_custkey", readers.record_line(F.from_json("j", "map<string,string>")).alias("line"))


@query()
def src6_html_text(spark, sf_dir):
    return readers.html_texts(table(spark, sf_dir, "pages"), "page_id", "html")


@query("SELECT left(regexp_replace(q, '[?？]+$', ''), 200) AS title, 'https://example.org/qa#row=' || conv_id AS source, '# ' || left(regexp_replace(q, '[?？]+$', ''), 200) || chr(10) || chr(10) || '## 问题' || chr(10) || q || chr(10) || chr(10) || '## 数据集答案' || chr(10) || a AS content FROM (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS q, min_by(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1) WHERE q IS NOT NULL AND a IS NOT NULL")
def src8_qa_documents(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    first = lambda r: F.min(F.when(F.col("role") == r, F.struct("turn", "text")))
    rows = c.groupBy(F.col("conv_id").alias("row_index")).agg(first("user").alias("q"), first("assistant").alias("a")).select("row_index", F.col("q.text").alias("question"), F.col("a.text").alias("answer")).where("question is not null and answer is not null")
    return readers.qa_documents(rows, "https://example.org/qa")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 5 = 0 THEN 'skip' WHEN doc_id % 7 = 0 THEN 'conflict' ELSE 'create' END AS action FROM documents")
def src9_reconcile(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.concat(F.lit("t"), "doc_id").alias("title"), F.concat(F.lit("u"), "doc_id").alias("url"), F.concat(F.lit("h"), "doc_id").alias("sha256"))
    stored = d.where("key % 5 = 0 or key % 7 = 0").withColumn("sha256", F.when(F.col("key") % 5 == 0, F.col("sha256")).otherwise("other"))
    return readers.reconcile(d, stored)


@query()
def src10_normalised(spark, sf_dir):
    e = readers.text_elements(table(spark, sf_dir, "documents"), "doc_id", "text")
    return readers.normalised_elements(e, "doc_id", F.concat(F.lit("source: "), F.col("doc_id")))


@query("SELECT page_id, sha256(html) AS sha256, 'text/html' AS mime, CASE WHEN page_id % 4 = 0 THEN 'declared type differs' END AS warning FROM pages WHERE page_id % 3 <> 2")
def src12_register(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.col("page_id"), F.when(F.col("page_id") % 3 == 2, ".exe").otherwise(".html")).alias("path"), F.col("html").cast("binary").alias("content"), F.when(F.col("page_id") % 4 == 0, "text/plain").otherwise("text/html").alias("declared"))
    return readers.register(p).select("page_id", "sha256", "mime", "warning")


@query("SELECT '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\",\"raw\":{\"base64\":\"' || base64(encode(c_mktsegment)) || '\"}}' AS value FROM customer")
def snk1_export(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("raw", F.col("c_mktsegment").cast("binary"))
    return sinks.export_lines(c, ["c_name", "c_custkey", "raw"])


@query("SELECT count(*) AS records, list_aggregate(list_sort(list(DISTINCT lang)), 'string_agg', ',') AS languages, sha256(CAST(sum(('0x' || substr(sha256(text), 1, 12))::BIGINT) AS VARCHAR)) AS sha256 FROM documents")
def snk2_manifest(spark, sf_dir):
    return sinks.manifest(table(spark, sf_dir, "documents"), "lang", "text").withColumn("languages", F.array_join("languages", ","))


@query("SELECT event_id, '{\"mail\":\"[REDACTED_EMAIL]\",\"k\":' || event_id || '}' AS details FROM events")
def snk3_audit(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("user"), "user_id", F.lit("@example.com")).alias("mail"))
    return sinks.audit_rows(e, F.struct("mail", F.col("event_id").alias("k"))).select("event_id", "details")


@query("SELECT event_id, round(greatest(0.0, value - 20), 3) AS duration_ms, left(props, 2000) AS details FROM events")
def snk4_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") - 20).alias("duration_ms"), F.col("props").alias("details"))
    return sinks.metric_rows(e)


@query("SELECT start, event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(sum(CAST(value AS DECIMAL(18,6)))::DOUBLE / count(value) + 1e-9, 4) AS mean FROM (SELECT *, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 23 HOUR, time_bucket(INTERVAL 1 HOUR, ts), INTERVAL 1 HOUR)) AS start FROM events) GROUP BY 1, 2")
def str3_rolling(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("outcome", F.when(F.col("event_type") == "error", "error").otherwise("ok"))
    return streams.rolling(e, "ts", ["event_type"], "value")


@query("""WITH s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events))
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS turns FROM s GROUP BY user_id, g""")
def str6_sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"])


@query("SELECT event_id, '[REDACTED_EMAIL] ' || event_type AS details FROM events")
def str5_audit(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return streams.audit(e, F.concat(F.lit("u"), "user_id", F.lit("@example.com "), "event_type")).select("event_id", "details")
