"""Incremental pilot ledger: append-only JSON lines to the latest record per job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ledger_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """New ledger events, however late; none is dropped.

    An event delivered again has the ``seq`` and content of its first delivery, so
    the latest record per job is the same with it and without it.
    """
    return spark.readStream.schema(schema).json(path)


def maintain_latest(events: DataFrame, checkpoint: str) -> StreamingQuery:
    """Keep the latest event of every job in the query's own state, under ``checkpoint``.

    The state is the table: Spark writes what a batch changed, not what it left
    alone, and drops what versions older than ``spark.sql.streaming.minBatchesToRetain``
    need, so storage follows the number of jobs and not of batches. A batch that is
    run again changes nothing twice. ``build_session`` keeps state in RocksDB, whose
    size the heap does not bound.
    """
    rest = [c for c in events.columns if c != "job_id"]
    newest = events.groupBy("job_id").agg(F.max_by(F.struct(*rest), "seq").alias("newest"))
    return newest.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The latest event of every job after the last batch, or after ``batch`` where that is still kept."""
    reader = spark.read.format("statestore")
    rows = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    return rows.select("key.job_id", "value.valueWithExtremumOrdering.*")
