"""Session defaults and the shared scratch folder.

Nothing here is tied to one machine: intermediate tables go below ``spark.checkpoint.dir``, which a
cluster points at shared storage. Only when that setting is absent (unit tests) is a local folder made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def build_session(app_name: str = "earmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library defaults; keyword arguments use ``__`` for dots in setting names."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; if it is unset, a temporary one in local mode, else an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if configured:
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if jsc.getCheckpointDir().isEmpty():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="earmark-"))
    return jsc.getCheckpointDir().get()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/earmark/{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame, label: str = "pinned") -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it from there.

    Used where a value depends on physical placement (a range partition number) and must not change if an
    executor is lost and rows are computed again, or where several passes follow. A Parquet table rather than
    a checkpoint, because later passes then read only the columns they need.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
