"""A session with the settings the library expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``master`` and extra settings are optional."""
    builder = SparkSession.builder.appName("lodestar")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the cluster names in spark.checkpoint.dir; a local session without one (a test) gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what follows does not compute it again."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
