"""Made-up samples for demonstrations and benches, from expressions over ranges: any number of rows, made on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.samples import block_base
from tidemark.functions.selector import series_column

START = 1_700_000_000


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that hangs on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def shape(spark: SparkSession, kind: str, n: int, seed: int = 1) -> DataFrame:
    """t, v and seq of one of three shapes: `steps` repeats whole numbers for long runs, `drift` changes a little each
    second, `noise` has full entropy at uneven times."""
    i = F.col("id")
    rows = spark.range(n)
    if kind == "steps":
        run = F.floor(i / 7 + uniform(seed, F.floor(i / 50)))
        return rows.select((F.lit(START) + i).alias("t"), F.floor(uniform(seed + 1, run) * 500).cast("double").alias("v"), i.alias("seq"))
    if kind == "drift":
        slow = F.sin(i / 97.0) * 6 + F.sin(i / 1013.0) * 9
        return rows.select((F.lit(START) + i).alias("t"), (50 + slow + uniform(seed, i)).alias("v"), i.alias("seq"))
    if kind == "noise":
        return rows.select((F.lit(START) + i * 3 + F.floor(uniform(seed, i) * 3)).alias("t"), ((uniform(seed + 1, i) - 0.5) * 2e6).alias("v"), i.alias("seq"))
    raise ValueError(f"unknown shape {kind!r}")


def hosts(spark: SparkSession, n_hosts: int, n_ticks: int, step: int = 1, start: int = START, seed: int = 1) -> DataFrame:
    """Samples of five metrics of each host, with labels host, job and region."""
    host = F.concat(F.lit("h"), F.col("host").cast("string"))
    noise = lambda k: uniform(seed + k, F.col("host"), F.col("tick")) - 0.5
    # Centre, swing and period of each metric.
    cpu = F.round(45 + 15 * F.sin(F.col("tick") / 300 + F.col("host")) + 8 * noise(1), 4)
    values = {
        "cpu_usage": cpu,
        "load_1m": F.round(F.greatest(F.lit(0.0), cpu / 25 + noise(2) * 0.4), 3),
        "temp_c": F.round(38 + 12 * F.sin(F.col("t") / 600) + noise(3), 2),
        "mem_used_bytes": F.floor(2.2e9 + 4e8 * F.sin(F.col("tick") / 5000) + noise(4) * 8e6).cast("double"),
        "requests_total": F.floor(F.col("tick") / 3).cast("double") * 20,
    }
    rows = spark.range(n_hosts * n_ticks).select((F.col("id") % n_hosts).alias("host"), F.floor(F.col("id") / n_hosts).alias("tick"))
    rows = rows.withColumn("t", F.lit(start) + F.col("tick") * step)
    labels = F.create_map(F.lit("host"), host, F.lit("job"), F.lit("node"), F.lit("region"), F.concat(F.lit("r"), (F.col("host") % 3).cast("string")))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in values.items())))
    rows = rows.withColumn("labels", labels).withColumn("x", each)
    return rows.select(F.col("x.metric").alias("metric"), series_column(F.col("x.metric"), F.col("labels")).alias("series"), "labels", "t", F.col("x.v").alias("v"), F.col("tick").alias("seq"), block_base(F.col("t")).alias("block_base"))
