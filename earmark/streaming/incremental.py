"""Resumable processing of new input files into a ledger."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.operators.merging import remaining
from earmark.session import pin
from earmark.sources.jsonl import append_ledger, parse_lines, write_jsonl


def run_pending(work: DataFrame, ledger: DataFrame, ledger_path: str, key: str, process: Callable[[DataFrame], DataFrame],
                retry_failed: bool = False, record_failures: bool = True) -> None:
    """Batch form: process the work whose keys the ledger lacks and append the results.

    A ledger that records failures does not retry them; one that records only successes retries by itself.
    """
    results = process(remaining(work, ledger, key, retry_failed))
    append_ledger(results if record_failures else results.filter(F.col("status") == "ok"), ledger_path)


#: Buckets of the table of processed keys.
KEY_BUCKETS = 64


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the stream that a checkpoint belongs to; a new checkpoint is a new stream, whose batches are counted from 0 again."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def _known_keys(spark: SparkSession, path: str, key: str, kind: str, touched: list[int], batch: str) -> DataFrame:
    """Keys of the touched buckets, other than those of a run of the same batch that broke off."""
    schema = f"`{key}` {kind}, bucket INT, batch STRING"
    try:
        keys = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        keys = spark.createDataFrame([], schema)
    return keys.filter(F.col("bucket").isin(touched) & (F.col("batch") != batch)).select(key, "bucket")


def process_new_files(
    spark: SparkSession, source: str, schema: str, process: Callable[[DataFrame], DataFrame], ledger_path: str,
    checkpoint: str, key: str, record_failures: bool = True, max_files_per_batch: int = 1000, keys_path: str | None = None, buckets: int = KEY_BUCKETS,
) -> None:
    """Streaming form: process files that arrived since the last call, then stop.

    A key is processed once over all calls, also after its checkpoint is lost. The stream itself keeps no state: processed keys are a table
    (``keys_path``, by default beside the ledger) in hash buckets, and a micro-batch is held against the buckets that its keys fall into.
    Each micro-batch writes its own folders of the ledger and of the keys, named by stream and number and overwritten if the batch is
    run again; a restart after a failure never doubles rows. Failures that the ledger does not record are retried with
    :func:`run_pending`. Malformed lines and rows without a key are left out.
    """
    keys_path = keys_path or f"{ledger_path.rstrip('/')}_keys"

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        name = f"{_stream_id(own, checkpoint)}-{batch_id}"
        rows = pin(batch.dropDuplicates([key]).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "arrived")
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most one a bucket
        known = _known_keys(own, keys_path, key, batch.schema[key].dataType.simpleString(), touched, name).withColumnRenamed("bucket", "_bucket")
        fresh = pin(rows.join(known, ["_bucket", key], "left_anti"), "fresh")
        results = process(fresh.select(*batch.columns))
        write_jsonl(results if record_failures else results.filter(F.col("status") == "ok"), f"{ledger_path}/batch={name}", "overwrite")
        fresh.select(key, F.col("_bucket").alias("bucket"), F.lit(name).alias("batch")).repartition("bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(keys_path)

    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_batch).text(source)
    stream = parse_lines(lines, schema).filter(F.trim(F.col(key).cast("string")) != "")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def compact_keys(spark: SparkSession, keys_path: str, out: str, key: str, kind: str) -> None:
    """The table of processed keys, one file a bucket, in a new folder for the runs from now on."""
    keys = spark.read.schema(f"`{key}` {kind}, bucket INT, batch STRING").parquet(keys_path)
    keys.select(key, "bucket").distinct().withColumn("batch", F.lit("compacted")).repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("batch", "bucket").parquet(out)


def read_ledger(spark: SparkSession, ledger_path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch STRING").json(ledger_path)
