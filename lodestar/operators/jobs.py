"""Intake, synchronisation and states of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import row_numbers


def intake(requests: DataFrame, known: DataFrame, by: list[str], payload: str, order: str) -> DataFrame:
    """JOB1: adds ``decision``: new, duplicate (same key and payload) or conflict (same key, other payload).

    The first request of a key stands for it, unless the key is known already.
    """
    w = Window.partitionBy(*by).orderBy(order)
    first = F.first(payload).over(w)
    joined = requests.join(known.select(*by, F.col(payload).alias("_known")), by, "left")
    stands = F.coalesce("_known", first)
    new = F.col("_known").isNull() & (F.row_number().over(w) == 1)
    return joined.withColumn("decision", F.when(new, "new").when(F.col(payload) == stands, "duplicate").otherwise("conflict")).drop("_known")


def deduplicate(rows: DataFrame, known: DataFrame, by: list[str], digest: str, key: str) -> DataFrame:
    """JOB2: rows whose content is new within their scope, the least key of each; an empty digest is never a repeat."""
    exempt, hashed = rows.where(F.col(digest) == ""), rows.where(F.col(digest) != "")
    fresh = hashed.join(known.select(*by, digest), [*by, digest], "left_anti")
    w = Window.partitionBy(*by, digest).orderBy(key)
    return fresh.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").unionByName(exempt)


def sync(current: DataFrame, incoming: DataFrame, key: str, fields: list[str], refresh: bool = True) -> DataFrame:
    """JOB3: each incoming row with ``action``: created, updated (a field differs, and refresh) or skipped."""
    old = current.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_there"))
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    action = F.when(F.col("_there").isNull(), "created").when(differs & F.lit(refresh), "updated").otherwise("skipped")
    return incoming.join(old, key, "left").withColumn("action", action).select(*incoming.columns, "action")


def upsert_blobs(stored: DataFrame, incoming: DataFrame, model: str) -> DataFrame:
    """EMB4: one row for each (tenant, sha256); an embedding that is missing or of another model is taken anew."""
    new = incoming.groupBy("tenant_id", "sha256").agg(F.max(F.struct("embedding_model", "vector")).alias("n"))
    old = stored.select("tenant_id", "sha256", F.struct("embedding_model", "vector").alias("o"))
    both = new.join(old, ["tenant_id", "sha256"], "full")
    keep = F.col("o").isNotNull() & F.col("o.vector").isNotNull() & (F.col("o.embedding_model") == model)
    pick = F.when(keep, F.col("o")).otherwise(F.coalesce("n", "o"))
    return both.select("tenant_id", "sha256", pick["embedding_model"].alias("embedding_model"), pick["vector"].alias("vector"), F.when(F.col("o").isNull(), "inserted").when(keep | F.col("n").isNull(), "kept").otherwise("refreshed").alias("action"))


def lease_audit(jobs: DataFrame, as_of: Column) -> DataFrame:
    """JOB4: adds ``lease``: exhausted, reclaimable, claimable or held, and the claim order within the tenant of those that may run, without a window over a tenant."""
    expired = F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < as_of)
    lease = F.when((F.col("state") == "running") & expired & (F.col("attempt") >= F.col("max_attempts")), "exhausted").when((F.col("state") == "running") & expired, "reclaimable").when(F.col("state") == "queued", "claimable").when(F.col("state") == "running", "held").otherwise("finished")
    marked = jobs.withColumn("lease", lease)
    runs = F.col("lease").isin("reclaimable", "claimable")
    claimed = row_numbers(marked.where(runs), ["tenant_id"], ["created_at", "id"], "claim_order").withColumn("claim_order", F.col("claim_order").cast("int"))
    return claimed.unionByName(marked.where(~runs).withColumn("claim_order", F.lit(None).cast("int")))


def terminal_state(maps: DataFrame, by: list[str]) -> DataFrame:
    """JOB5, AG4: total, succeeded, failed and the state they give."""
    out = maps.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))
    return out.withColumn("state", F.when(F.col("failed") == F.col("total"), "failed").when(F.col("failed") > 0, "partial").otherwise("succeeded"))


def retry_state(attempt: Column, max_attempts: Column) -> Column:
    """JOB5: what a failed attempt leaves."""
    return F.when(attempt < max_attempts, "queued").otherwise("failed")


def resume_marker(runs: DataFrame, by: list[str], order: str) -> DataFrame:
    """CKP1, WN2, WN3: of each run its last checkpoint; ``resumed_from`` is the run before if that ended running or failed."""
    last = Window.partitionBy(*by, "run_id").orderBy(F.desc(order))
    ends = runs.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    w = Window.partitionBy(*by).orderBy(order)
    before, status = F.lag("run_id").over(w), F.lag("status").over(w)
    return ends.withColumn("resumed_from", F.when(status.isin("running", "failed"), before))


def numbered(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """WN4: the sequence number within a run."""
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
