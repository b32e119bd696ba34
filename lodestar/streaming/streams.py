"""Continuous forms: ingest, intake, rolling metrics, latest states, audit and sessions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..functions.text import redact_pii
from ..operators.chunking import boundary_chunks
from ..operators.jobs import deduplicate
from ..operators.relations import latest
from .store import PostingStore


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, base: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """STR1: chunks of new documents under ``base``/chunks, their postings and statistics in a ``PostingStore`` there; rows without text under ``base``/dead; content seen before is skipped.

    A batch that runs again overwrites its own folders, so recovery repeats nothing.
    """
    store = PostingStore(stream.sparkSession, base)

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bad = F.coalesce(F.trim("text"), F.lit("")) == ""
        batch.where(bad).write.mode("overwrite").parquet(f"{base}/dead/batch={number}")
        rows = batch.where(~bad).withColumn("sha256", F.sha2("text", 256)).withColumn("tenant", F.lit("t"))
        try:
            seen = spark.read.parquet(f"{base}/seen").where(F.col("batch") != number)
        except Exception as e:  # the first batch has no such folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            seen = spark.createDataFrame([], "tenant string, sha256 string, batch int")
        fresh = deduplicate(rows, seen, ["tenant"], "sha256", key)
        boundary_chunks(fresh, key, "text").write.mode("overwrite").parquet(f"{base}/chunks/batch={number}")
        store.add(spark.read.parquet(f"{base}/chunks/batch={number}"), number, key)
        fresh.select("tenant", "sha256").write.mode("overwrite").parquet(f"{base}/seen/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timed(rows: DataFrame, time: str, late: str) -> DataFrame:
    """With a watermark; a time without a zone counts as the session's."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def intake(stream: DataFrame, by: list[str], time: str, late: str = "24 hours") -> DataFrame:
    """STR2: the first row of each key within the watermark."""
    return timed(stream, time, late).dropDuplicatesWithinWatermark(by)


def rolling(rows: DataFrame, time: str, by: list[str], value: str, length: str = "24 hours", slide: str = "1 hour", late: str | None = None) -> DataFrame:
    """STR3: count, errors and mean of sliding windows; the same on a batch and, with ``late``, on a stream. The mean is of decimals, so it does not hang on the order of the sum, and halves go up."""
    rows = timed(rows, time, late) if late else rows
    w = F.window(time, length, slide)
    return rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "error").alias("errors"), F.round(F.sum(F.col(value).cast("decimal(18,6)")).cast("double") / F.count(value) + 1e-9, 4).alias("mean")).select(F.col("w.start").alias("start"), *by, "n", "errors", "mean")


class _Latest(StatefulProcessor):
    """Keeps the highest order of an identity and lets through the rows that raise it."""

    def __init__(self, by: list[str], order: str, columns: list[str], ttl_ms: int):
        self.by, self.order, self.columns, self.ttl_ms = by, order, columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long", self.ttl_ms or None)

    def handleInputRows(self, key, rows, timers):
        have = self.seen.get()[0] if self.seen.exists() else None
        best = None
        for part in rows:
            part = part[part[self.order].notna()]
            if len(part):
                top = part.loc[[part[self.order].astype("int64").idxmax()]]
                at = int(top[self.order].iloc[0])
                if (have is None or at > have) and (best is None or at > int(best[self.order].iloc[0])):
                    best = top
        if best is not None:
            self.seen.update((int(best[self.order].iloc[0]),))
            yield best[self.columns]

    def close(self) -> None:
        pass


def latest_states(stream: DataFrame, by: list[str], order: str, path: str, checkpoint: str, ttl: str = "0 seconds") -> StreamingQuery:
    """STR4: each row that is the latest of its identity so far goes to ``path``/batch=n; ``current_states`` gives the last of each.

    The state is one number for each identity, forgotten ``ttl`` after it last rose (never, if zero); an older row that comes
    after that is written once more, and does no harm. order: a whole number. Needs the state store of RocksDB (``use_rocksdb``).
    """
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    changes = stream.groupBy(*by).transformWithStateInPandas(_Latest(by, order, stream.columns, ttl_ms), stream.schema, "Update", "ProcessingTime" if ttl_ms else "None")

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that STR4 needs; for streams that start after this."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def current_states(spark: SparkSession, by: list[str], order: str, path: str) -> DataFrame:
    """STR4: the latest row of each identity."""
    return latest(spark.read.parquet(path).drop("batch"), by, order)


class LateRows(StreamingQueryListener):
    """STR2: rows that came after the watermark and were dropped, by name of the query; add it by ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.dropped[p.name] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def audit(stream: DataFrame, details: Column) -> DataFrame:
    """STR5: redacted details; stateless, so the same on a batch."""
    return stream.withColumn("details", redact_pii(details))


def sessions(rows: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """STR6: sessions by gap; the same on a batch and, with ``late``, on a stream."""
    rows = timed(rows, time, late) if late else rows
    w = F.session_window(time, gap)
    return rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("turns")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns")


def run_once(frame: DataFrame, checkpoint: str, name: str, mode: str = "append", sink: Callable | None = None) -> DataFrame:
    """Run a streaming frame over what there is, into a table in memory; for tests and replays."""
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.table(name)
