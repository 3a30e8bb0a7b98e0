"""Streaming ingest: exposition text that lands in a folder becomes samples in the table.

There is no watermark: late samples are never dropped. The checkpoint remembers which files were read, and a batch's
files lie in folders of its number, so a batch that runs again after a failure replaces what it has written before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.model import SAMPLES
from tidemark.sources import exposition
from tidemark.sources.store import by_block


def landing(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """Lines of all files that land, with file and time of its arrival."""
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("arrived"))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All samples that batches have stored."""
    return spark.read.schema(f"{SAMPLES}, batch long").parquet(path).drop("batch")


def start(spark: SparkSession, folder: str, table: str, checkpoint: str, on_batch: Callable[[DataFrame, DataFrame, int], None] | None = None, now: int | None = None, once: bool = False, every: str = "5 seconds") -> StreamingQuery:
    """on_batch gets a batch's samples, its errors and its number, after the samples are stored. A line without a time
    takes `now`, or else the time at which its file arrived. once: read what is there, then stop."""

    def store(batch: DataFrame, number: int) -> None:
        lines = exposition.lines_of(batch.withColumnRenamed("value", "body"))
        rows = exposition.parsed(lines, F.lit(now) if now is not None else F.unix_timestamp("arrived"))
        good = exposition.good(rows).withColumn("batch", F.lit(number))
        by_block(good).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "block_base").parquet(table)
        if on_batch:
            own = spark.read.schema(f"{SAMPLES}, batch long").parquet(table).where(F.col("batch") == number).drop("batch")
            on_batch(own, exposition.bad(rows), number)

    writer = landing(spark, folder).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
