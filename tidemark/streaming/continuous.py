"""Continuous aggregates and alerts over streams of samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.samples import largest, smallest
from tidemark.model import FIRING, SAMPLES
from tidemark.operators import rules as R
from tidemark.sources.store import Files


def sample_stream(spark: SparkSession, path: str) -> DataFrame:
    """New samples of a stored table, whose files appear whole."""
    return spark.readStream.schema(SAMPLES).parquet(path)


def rollup(samples: DataFrame, step: int, lateness: str = "1 hour") -> DataFrame:
    """Per series and bucket: avg, max, min, sum and count of a stream. A bucket is final, and leaves the state, when the
    watermark has passed it; later samples still are in the table, where a range query finds them."""
    timed = samples.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", lateness)
    v = F.col("v")
    grouped = timed.groupBy("series", F.window("ts", f"{step} seconds")).agg(F.avg(v).alias("avg"), largest(v).alias("max"), smallest(v).alias("min"), F.sum(v).alias("sum"), F.count("*").alias("count"))
    return grouped.select("series", F.unix_timestamp("window.start").alias("t"), "avg", "max", "min", "sum", "count")


class Firing:
    """What fires, as one small table per evaluation in a folder; the last whole one counts, after a restart too."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def last(self, before: int | None = None) -> int | None:
        """The number of the last whole evaluation, or of the last one before a number."""
        folder = Files(self.spark, self.path)
        done = (int(n) for n in folder.names() if n.isdigit() and folder.exists(f"{n}/_SUCCESS"))
        return max((n for n in done if before is None or n < before), default=None)

    def read(self, before: int | None = None) -> DataFrame:
        """What it has left: an evaluation that runs again begins where it began."""
        last = self.last(before)
        return R.empty_firing(self.spark) if last is None else self.spark.read.schema(FIRING).parquet(f"{self.path}/{last}")

    def write(self, firing: DataFrame, number: int) -> None:
        """Stores an evaluation; those before the one that it began with go."""
        began = self.last(number)
        firing.write.mode("overwrite").parquet(f"{self.path}/{number}")
        folder = Files(self.spark, self.path)
        for name in folder.names():
            if name.isdigit() and began is not None and int(name) < began:
                folder.system.delete(folder.path(name), True)


def watch(trigger: DataFrame, samples: Callable[[], DataFrame], rules: Callable[[], DataFrame], firing: Firing, clock: Callable[[int], int], on_alerts: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str = "5 seconds") -> StreamingQuery:
    """Evaluates all rules at every batch of a stream. Values come from the whole table, so series that have fallen
    silent resolve as well."""

    def tick(_: DataFrame, number: int) -> None:
        alerts, now_firing, _ = R.evaluate(samples(), rules(), firing.read(number), clock(number))
        on_alerts(alerts, number)
        firing.write(now_firing, number)

    writer = trigger.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
