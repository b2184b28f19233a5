"""Starting and finishing streaming queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from mlwatch.sources.history import by_date

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_off_heap(spark: SparkSession) -> None:
    """Use the RocksDB state store unless the session names another: state may outgrow the heap."""
    if spark.conf.get(STATE_STORE, None) in (None, "") or "HDFSBacked" in spark.conf.get(STATE_STORE):
        spark.conf.set(STATE_STORE, ROCKSDB)


def read_files(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream. See :func:`keep_state_off_heap` for large state."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def event_time(ts: str) -> Column:
    """Zoned timestamp: a watermark does not take one without a zone."""
    return F.col(ts).cast("timestamp")


def run_to_end(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything available, then stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_batch(batch: DataFrame, path: str, batch_id: int, ts: str) -> None:
    """Add a micro-batch under its dates, then its number; a retried batch replaces what it wrote."""
    rows = batch.withColumn("date", F.to_date(ts)).withColumn("batch", F.lit(batch_id).cast("long"))
    by_date(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "date", "batch"
    ).parquet(path)
