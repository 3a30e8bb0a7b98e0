"""Given tables as samples. A range of seconds becomes a filter on the raw time column, which reaches the Parquet scan."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.samples import block_base, seconds
from tidemark.functions.selector import series_column


def within(ts: Column, start: int | None, end: int | None) -> Column:
    """start <= floor(seconds) <= end, as a filter on the raw TIMESTAMP_NTZ."""
    moment = lambda s: F.lit((datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=s)).replace(tzinfo=None)).cast("timestamp_ntz")
    out = F.lit(True)
    if start is not None:
        out = out & (ts >= moment(start))
    if end is not None:
        out = out & (ts < moment(end + 1))
    return out


def as_samples(df: DataFrame, metric: str, labels: dict[str, Column], ts: str, value: str, seq: Column, start: int | None = None, end: int | None = None) -> DataFrame:
    pairs = [x for name, column in labels.items() for x in (F.lit(name), column)]
    df = df.where(within(F.col(ts), start, end)).select(F.lit(metric).alias("metric"), F.create_map(*pairs).alias("labels"), seconds(F.col(ts)).alias("t"), F.col(value).cast("double").alias("v"), seq.cast("long").alias("seq"))
    return df.select("metric", series_column(F.col("metric"), F.col("labels")).alias("series"), "labels", "t", "v", "seq", block_base(F.col("t")).alias("block_base"))


def events(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return as_samples(df, "event_value", {"event_type": F.col("event_type"), "user": F.col("user_id").cast("string")}, "ts", "value", F.col("event_id"), start, end)


def orders(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return as_samples(df, "order_total", {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}, "o_orderdate", "o_totalprice", F.col("o_orderkey"), start, end)


def lineitem(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return as_samples(df, "line_price", {"returnflag": F.col("l_returnflag"), "linestatus": F.col("l_linestatus")}, "l_shipdate", "l_extendedprice", F.col("l_orderkey") * 8 + F.col("l_linenumber"), start, end)
