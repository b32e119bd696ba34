"""Queries for scoped reads, joins, set operations, jobs and logs. Orders stand for documents, line items for chunks, customers for knowledge bases, events for logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs, logs, relations
from .registry import query, table


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'src0' AND lang = 'en'")
def flt1_tenant_scope(spark, sf_dir):
    """FLT1, SRC14: pushed down to the scan."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "n_chars", "source AS tenant_id", "lang AS knowledge_base_id")
    return relations.in_scope(rows, "src0", "en").select("doc_id", "n_chars")


@query("SELECT o_orderkey, 'accepted' AS verdict FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) UNION ALL SELECT o_orderkey, 'not found' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def flt2_unknown_base(spark, sf_dir):
    bases = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    ok, bad = relations.split_by_scope(table(spark, sf_dir, "orders"), bases, ["o_custkey"])
    return ok.select("o_orderkey", F.lit("accepted").alias("verdict")).unionByName(bad.select("o_orderkey", F.lit("not found").alias("verdict")))


@query(r"SELECT page_id FROM pages WHERE contains(lower(url), '.example.com/en') OR contains(lower(html), '100%_')")
def flt3_like(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(relations.like("url", ".EXAMPLE.com/en") | relations.like("html", "100%_")).select("page_id")


@query("SELECT vec_id FROM embeddings WHERE 'model-' || (label % 3) = 'model-1'")
def flt4_model_filter(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("embedding_model", F.concat(F.lit("model-"), F.col("label") % 3)).where("embedding_model = 'model-1'").select("vec_id")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def flt5_last_day(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("as_of")))).where(relations.since("ts", F.col("as_of"))).select("event_id")  # one row


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def prj1_metadata_only(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query("SELECT conv_id, turn, role, CAST(json_extract('{\"page\":' || turn || '}', '$.page') AS INTEGER) AS page FROM conversations")
def prj2_elements(spark, sf_dir):
    meta = F.format_string('{"page":%d}', "turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.from_json(meta, "page int")["page"].alias("page"))


@query("SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 50")
def prj3_recent(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id").orderBy(F.desc("event_id")).limit(50)


@query("SELECT c_custkey, concat_ws(',', CASE WHEN NOT regexp_matches(c_mktsegment, '^[A-Z]+$') THEN 'segment' END, CASE WHEN NOT (length(c_name) BETWEEN 1 AND 18) THEN 'name' END, CASE WHEN NOT (c_acctbal >= 0) THEN 'balance' END) AS broken FROM customer")
def prj4_validation(spark, sf_dir):
    rules = {"segment": F.col("c_mktsegment").rlike("^[A-Z]+$"), "name": F.length("c_name").between(1, 18), "balance": F.col("c_acctbal") >= 0}
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(relations.violations(rules), ",").alias("broken"))


@query("SELECT doc_id, source, n_chars FROM documents")
def prj5_public_answer(spark, sf_dir):
    """A struct of answer and evidence shown without the evidence's text."""
    a = table(spark, sf_dir, "documents").select("doc_id", F.struct("source", "n_chars", "text").alias("evidence"))
    return a.select("doc_id", F.col("evidence").dropFields("text").alias("e")).select("doc_id", "e.source", "e.n_chars")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, 120 < (SELECT count(*) FROM orders) AS has_more FROM orders ORDER BY o_orderkey DESC LIMIT 20 OFFSET 100")
def cat1_page(spark, sf_dir):
    return relations.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 20)


_COUNTS = "SELECT o_orderkey, coalesce(n, 0) AS chunks, coalesce(r, 0) AS returned FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) a ON a.l_orderkey = o_orderkey LEFT JOIN (SELECT l_orderkey, count(*) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON b.l_orderkey = o_orderkey"


@query(_COUNTS)
def cat2_child_counts(spark, sf_dir):
    """CAT2, JN3, AG1."""
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return relations.with_counts(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", {"chunks": items.select("o_orderkey"), "returned": items.where("l_returnflag = 'R'").select("o_orderkey")})


@query("SELECT l_orderkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def ag1_count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("parts"))


@query("SELECT l_orderkey, l_linenumber, p_name, o_orderdate FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority LIKE '1%'")
def cat3_placements(spark, sf_dir):
    """CAT3: placement x blob x document."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(o, "l_orderkey").join(p, "l_partkey").select("l_orderkey", "l_linenumber", "p_name", "o_orderdate")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def jn1_chunk_document(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey")
def jn2_three_way(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey").join(c, "c_custkey").select("l_orderkey", "l_linenumber", "c_name")


@query("SELECT c_custkey, count(o_orderkey) AS messages, max(o_orderdate) AS updated_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def jn4_left_count(spark, sf_dir):
    """JN4, CNV1's counts."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("messages"), F.max("o_orderdate").alias("updated_at"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def jn5_semi(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(r, "o_orderkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jn6_orphans(spark, sf_dir):
    return relations.missing(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


_BACK = """WITH c AS (SELECT l_orderkey AS document_id, l_linenumber AS chunk_index FROM lineitem), p AS (SELECT * FROM c WHERE document_id % 3 = 0), k AS (SELECT * FROM c WHERE document_id % 5 = 0)
SELECT 'parent' AS kind, * FROM p UNION ALL SELECT 'parent', * FROM c WHERE document_id NOT IN (SELECT document_id FROM p) UNION ALL SELECT 'child', * FROM k UNION ALL SELECT 'child', * FROM c WHERE document_id NOT IN (SELECT document_id FROM k)"""


@query(_BACK)
def jn7_backfill(spark, sf_dir):
    """JN7, CHK8."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"))
    parents, children = relations.backfill(c, c.where("document_id % 3 = 0"), c.where("document_id % 5 = 0"))
    return parents.withColumn("kind", F.lit("parent")).unionByName(children.withColumn("kind", F.lit("child")))


@query("WITH j AS (SELECT o_custkey, o_orderkey AS id FROM orders) SELECT o_custkey, id FROM j WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def jn8_pending(spark, sf_dir):
    requested = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"))
    return relations.missing(requested, table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id")), ["id"]).select("o_custkey", "id")


@query("SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_missing FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1")
def jn9_membership(spark, sf_dir):
    gone = relations.missing(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])
    return gone.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_missing"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)) THEN 'refused' ELSE 'answer' END AS outcome FROM orders")
def jn13_citation_scope(spark, sf_dir):
    """JN13, POL8: an answer (order) whose citations (line items) are not all of a visible supplier is refused."""
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    foreign = relations.missing(cited, table(spark, sf_dir, "supplier").where("s_nationkey < 20").select("s_suppkey"), ["s_suppkey"]).select("o_orderkey").distinct().withColumn("bad", F.lit(True))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(foreign, "o_orderkey", "left").select("o_orderkey", F.when(F.col("bad"), "refused").otherwise("answer").alias("outcome"))


@query("SELECT n_nationkey, '/' || lower(left(n_name, 2)) || '/' AS fragment, min(page_id) AS page_id FROM nation LEFT JOIN pages ON contains(url, '/' || lower(left(n_name, 2)) || '/') GROUP BY 1, 2")
def jn14_first_match(spark, sf_dir):
    cases = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("/"), F.lower(F.left("n_name", F.lit(2))), F.lit("/")).alias("fragment"))
    return relations.first_match(cases, table(spark, sf_dir, "pages").select("page_id", "url"), "fragment", "url", "n_nationkey", "page_id", strict=False)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def wn2_latest(spark, sf_dir):
    return relations.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def tk3_newest(spark, sf_dir):
    return relations.newest(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 3)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def tk2_order_limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(25)


@query("SELECT DISTINCT lang AS v FROM documents UNION SELECT DISTINCT role FROM conversations")
def st1_union_distinct(spark, sf_dir):
    return relations.union_distinct([table(spark, sf_dir, "documents").select(F.col("lang").alias("v")), table(spark, sf_dir, "conversations").select(F.col("role").alias("v"))])


@query("SELECT count(*) AS shared FROM (SELECT sha256(text) AS h FROM documents WHERE source = 'src0' INTERSECT SELECT sha256(text) FROM documents WHERE source <> 'src0')")
def st3_intersection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("h"))
    return relations.overlap_count(d.where("source = 'src0'"), d.where("source <> 'src0'"), "h")


@query("SELECT 'orders' AS source, o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'lineitem', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def st4_union_metrics(spark, sf_dir):
    """ST4, AG2: two job tables in one report."""
    a = logs.state_counts(table(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), F.col("o_orderstatus").alias("state")), ["source"], "state")
    b = logs.state_counts(table(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("source"), F.col("l_linestatus").alias("state")), ["source"], "state")
    return a.unionByName(b)


@query("SELECT 'left' AS side, count(*) AS n FROM (SELECT doc_id, lang FROM documents EXCEPT ALL SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'xx' ELSE lang END FROM documents) UNION ALL SELECT 'right', count(*) FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'xx' ELSE lang END FROM documents EXCEPT ALL SELECT doc_id, lang FROM documents)")
def ev15_output_parity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return relations.same_rows(d, d.withColumn("lang", F.when(F.col("doc_id") % 9 == 0, "xx").otherwise(F.col("lang")))).groupBy("side").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN known IS NULL AND r = 1 THEN 'new' WHEN event_type = coalesce(known, f) THEN 'duplicate' ELSE 'conflict' END AS decision FROM (SELECT *, row_number() OVER w AS r, first(event_type) OVER w AS f FROM events LEFT JOIN (SELECT user_id, min(event_type) AS known FROM events WHERE user_id % 10 = 0 GROUP BY 1) USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def job1_intake(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    known = e.where("user_id % 10 = 0").groupBy("user_id").agg(F.min("event_type").alias("event_type"))
    return jobs.intake(e, known, ["user_id"], "event_type", "event_id").select("event_id", "decision")


@query("WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 17 = 0 THEN '' ELSE sha256(text) END AS h FROM documents), k AS (SELECT DISTINCT source, h FROM d WHERE doc_id % 29 = 0) SELECT min(doc_id) AS doc_id FROM d WHERE h <> '' AND (source, h) NOT IN (SELECT (source, h) FROM k) GROUP BY source, h UNION ALL SELECT doc_id FROM d WHERE h = ''")
def job2_deduplicate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.sha2("text", 256)).alias("h"))
    return jobs.deduplicate(d, d.where("doc_id % 29 = 0"), ["source"], "h", "doc_id").select("doc_id")


@query("SELECT action, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'created' WHEN c_custkey % 7 = 0 THEN 'updated' ELSE 'skipped' END AS action FROM customer) GROUP BY 1")
def job3_sync(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    old = new.where("c_custkey % 4 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 7 == 0, "old").otherwise(F.col("c_name")))
    return jobs.sync(old, new, "c_custkey", ["c_name", "c_acctbal"]).groupBy("action").agg(F.count("*").alias("n"))


_JOB = """(SELECT o_orderkey AS id, CAST(o_custkey % 5 AS VARCHAR) AS tenant_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'queued' ELSE 'done' END AS state, o_orderdate + INTERVAL 30 DAY AS lease_expires_at, CAST(o_orderkey % 4 AS INTEGER) AS attempt, 3 AS max_attempts, o_orderdate AS created_at FROM orders)"""


@query(f"SELECT id, lease, CASE WHEN lease IN ('reclaimable', 'claimable') THEN CAST(row_number() OVER (PARTITION BY tenant_id, lease IN ('reclaimable', 'claimable') ORDER BY created_at, id) AS INTEGER) END AS claim_order FROM (SELECT *, CASE WHEN state = 'running' AND lease_expires_at < TIMESTAMP '1998-01-01' AND attempt >= max_attempts THEN 'exhausted' WHEN state = 'running' AND lease_expires_at < TIMESTAMP '1998-01-01' THEN 'reclaimable' WHEN state = 'queued' THEN 'claimable' WHEN state = 'running' THEN 'held' ELSE 'finished' END AS lease FROM {_JOB})")
def job4_lease_audit(spark, sf_dir):
    j = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CAST(o_custkey % 5 AS STRING) AS tenant_id", "CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'queued' ELSE 'done' END AS state", "o_orderdate + INTERVAL 30 DAYS AS lease_expires_at", "CAST(o_orderkey % 4 AS INT) AS attempt", "3 AS max_attempts", "o_orderdate AS created_at")
    return jobs.lease_audit(j, F.lit("1998-01-01").cast("timestamp")).select("id", "lease", "claim_order")


@query("SELECT l_orderkey, total, succeeded, failed, CASE WHEN failed = total THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'succeeded' END AS state FROM (SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_returnflag <> 'R') AS succeeded, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1)")
def job5_terminal_state(spark, sf_dir):
    """JOB5, AG4."""
    maps = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "failed").otherwise("succeeded").alias("status"))
    return jobs.terminal_state(maps, ["l_orderkey"])


@query("SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey % 10 <> 3 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)")
def job6_cascade(spark, sf_dir):
    o, i = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    left = relations.delete_cascade(o.where("o_custkey % 10 = 3"), {"orders": o, "lineitem": i}, "o_orderkey")
    return left["orders"].agg(F.count("*").alias("n")).withColumn("name", F.lit("orders")).unionByName(left["lineitem"].agg(F.count("*").alias("n")).withColumn("name", F.lit("lineitem")))


_RUNS = "(SELECT user_id, event_id // 40 AS run_id, event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status FROM events)"


@query(f"SELECT user_id, run_id, status, CASE WHEN lag(status) OVER w IN ('running', 'failed') THEN lag(run_id) OVER w END AS resumed_from FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run_id ORDER BY event_id DESC) AS r FROM {_RUNS}) WHERE r = 1) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def ckp1_resume_marker(spark, sf_dir):
    """CKP1, WN3."""
    runs = table(spark, sf_dir, "events").selectExpr("user_id", "event_id DIV 40 AS run_id", "event_id", "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status")
    return jobs.resume_marker(runs, ["user_id"], "event_id").select("user_id", "run_id", "status", "resumed_from")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS sequence FROM events")
def wn4_sequence(spark, sf_dir):
    return jobs.numbered(table(spark, sf_dir, "events"), ["user_id"], "event_id").select("event_id", "sequence")


@query("WITH i AS (SELECT label::VARCHAR AS tenant_id, CAST(vec_id % 40 AS VARCHAR) AS sha256, max(vec_id) AS v FROM embeddings GROUP BY ALL), o AS (SELECT DISTINCT label::VARCHAR AS tenant_id, CAST(vec_id % 40 AS VARCHAR) AS sha256, (vec_id % 40) % 2 AS m FROM embeddings WHERE vec_id % 40 < 20) SELECT tenant_id, sha256, 'm1' AS embedding_model, CASE WHEN m IS NULL THEN 'inserted' WHEN m = 1 THEN 'kept' ELSE 'refreshed' END AS action FROM i LEFT JOIN o USING (tenant_id, sha256)")
def emb4_blob_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("tenant_id"), (F.col("vec_id") % 40).cast("string").alias("sha256"), F.lit("m1").alias("embedding_model"), "vec_id")
    new = e.select("tenant_id", "sha256", "embedding_model", F.col("vec_id").alias("vector"))
    old = e.where("vec_id % 40 < 20").select("tenant_id", "sha256", F.when(F.col("sha256").cast("int") % 2 == 1, "m1").otherwise("m0").alias("embedding_model"), F.lit(0).cast("long").alias("vector")).distinct()
    return jobs.upsert_blobs(old, new, "m1").select("tenant_id", "sha256", "embedding_model", "action")


_P = "(SELECT {by}, round(v, 3) AS {name} FROM (SELECT *, {value} AS v, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS i, count({value}) OVER (PARTITION BY {by}) AS n FROM {rows}) WHERE i = {at} + 1)"


def nearest_sql(rows: str, by: str, value: str, p: float, name: str, floor: bool = False) -> str:
    at = f"floor((n - 1) * {p}::DOUBLE)" if floor else f"round_even((n - 1) * {p}::DOUBLE, 0)"
    return _P.format(rows=rows, by=by, value=value, name=name, at=at)


@query(f"SELECT * FROM {nearest_sql('events', 'event_type', 'value', 0.95, 'p95')} JOIN {nearest_sql('events', 'event_type', 'value', 0.95, 'p95_floor', True)} USING (event_type)")
def ag8_percentiles(spark, sf_dir):
    """AG8, AG9."""
    e = table(spark, sf_dir, "events")
    return logs.nearest_rank(e, ["event_type"], "value", 0.95, "p95").join(logs.nearest_rank(e, ["event_type"], "value", 0.95, "p95_floor", True), "event_type")


@query("SELECT user_id % 7 AS tenant, CAST(greatest(0, epoch((SELECT date_trunc('second', max(ts)) FROM events)) - floor(epoch(min(ts) FILTER (event_type = 'view')))) AS BIGINT) AS oldest_seconds FROM events GROUP BY 1")
def ag3_oldest_age(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    j = e.withColumn("tenant", F.col("user_id") % 7).withColumn("created_at", F.col("ts")).crossJoin(F.broadcast(e.agg(F.date_trunc("second", F.max("ts")).alias("as_of"))))  # one row
    return logs.oldest_age(j, ["tenant", "as_of"], F.col("as_of"), F.col("event_type") == "view").select("tenant", "oldest_seconds")


_REQ = "(SELECT user_id % 7 AS tenant, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, event_id % 9 = 0 AS abstained, value AS latency_ms, event_id % 100 AS token_usage, CASE WHEN event_id % 11 = 0 THEN 'model+fallback' ELSE 'offline' END AS provider FROM events)"


@query(f"SELECT tenant, n, errors, abstained, mean_ms, tokens, fallbacks, p95_ms FROM (SELECT tenant, count(*) AS n, count(*) FILTER (status_code >= 400) AS errors, count(*) FILTER (abstained) AS abstained, round(avg(latency_ms), 3) AS mean_ms, CAST(sum(token_usage) AS BIGINT) AS tokens, count(*) FILTER (contains(provider, 'fallback')) AS fallbacks FROM {_REQ} GROUP BY 1) JOIN {nearest_sql(_REQ, 'tenant', 'latency_ms', 0.95, 'p95_ms')} USING (tenant)")
def ag5_request_rollup(spark, sf_dir):
    r = table(spark, sf_dir, "events").selectExpr("user_id % 7 AS tenant", "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code", "event_id % 9 = 0 AS abstained", "value AS latency_ms", "event_id % 100 AS token_usage", "CASE WHEN event_id % 11 = 0 THEN 'model+fallback' ELSE 'offline' END AS provider")
    return logs.request_rollup(r, ["tenant"])


_STG = "(SELECT * FROM (SELECT user_id % 7 AS tenant, event_type AS stage, CASE WHEN event_id % 13 = 0 THEN 'error' ELSE 'ok' END AS outcome, value AS duration_ms, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id DESC) AS r FROM events) WHERE r <= 1000)"


@query(f"SELECT tenant, stage, n, errors, mean_ms, p95_ms FROM (SELECT tenant, stage, count(*) AS n, count(*) FILTER (outcome = 'error') AS errors, round(avg(duration_ms), 3) AS mean_ms FROM {_STG} GROUP BY 1, 2) JOIN {nearest_sql(_STG, 'tenant, stage', 'duration_ms', 0.95, 'p95_ms')} USING (tenant, stage)")
def ag6_stage_rollup(spark, sf_dir):
    s = table(spark, sf_dir, "events").selectExpr("user_id % 7 AS tenant", "event_id AS id", "event_type AS stage", "CASE WHEN event_id % 13 = 0 THEN 'error' ELSE 'ok' END AS outcome", "value AS duration_ms")
    return logs.stage_rollup(s, ["tenant"])


_AUD = """(SELECT user_id % 7 AS tenant, event_id AS id, CASE event_id % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'search' ELSE 'login' END AS action, CASE event_id % 6 WHEN 0 THEN '{"retrieval_strategy":"rrf","routing_reason":"r1"}' WHEN 1 THEN '{"strategy":"bm25"}' WHEN 3 THEN 'broken{' ELSE '{"routing_reason":"r2"}' END AS details FROM events)"""


@query(f"""WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY id DESC) AS r FROM {_AUD} WHERE action IN ('answer', 'search')) WHERE r <= 5000),
j AS (SELECT tenant, json_valid(details) AS ok, CASE WHEN json_valid(details) THEN details END AS d FROM a)
SELECT tenant, facet, value, count(*) AS n FROM (SELECT tenant, 'strategy' AS facet, coalesce(d->>'$.retrieval_strategy', d->>'$.strategy') AS value FROM j UNION ALL SELECT tenant, 'reason', d->>'$.routing_reason' FROM j UNION ALL SELECT tenant, 'malformed', CASE WHEN NOT ok THEN 'true' END FROM j) WHERE value IS NOT NULL GROUP BY ALL""")
def ag7_routing_rollup(spark, sf_dir):
    a = table(spark, sf_dir, "events").selectExpr("user_id % 7 AS tenant", "event_id AS id", "CASE event_id % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'search' ELSE 'login' END AS action", """CASE event_id % 6 WHEN 0 THEN '{"retrieval_strategy":"rrf","routing_reason":"r1"}' WHEN 1 THEN '{"strategy":"bm25"}' WHEN 3 THEN 'broken{' ELSE '{"routing_reason":"r2"}' END AS details""")
    return logs.routing_rollup(a, ["tenant"])


@query(f"SELECT event_type, n, mean, median, least, most, p95, p99 FROM (SELECT event_type, count(value) AS n, round(avg(value), 3) AS mean, round(median(value), 3) AS median, round(min(value), 3) AS least, round(max(value), 3) AS most FROM events GROUP BY 1) JOIN {nearest_sql('events', 'event_type', 'value', 0.95, 'p95')} USING (event_type) JOIN {nearest_sql('events', 'event_type', 'value', 0.99, 'p99')} USING (event_type)")
def ag10_latency_summary(spark, sf_dir):
    return logs.latency_summary(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("SELECT user_id, round(median(value), 3) AS median, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def ag11_repeated_runs(spark, sf_dir):
    return logs.repeated_runs(table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error"), ["user_id"], "value")
