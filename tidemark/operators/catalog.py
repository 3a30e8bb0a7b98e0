"""The series catalog, label statistics, blocks, the high-water mark, and storage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.samples import block_base, largest, smallest
from tidemark.functions.selector import labels_column, series_name
from tidemark.model import BLOCK_SAMPLES

#: Names that bounds are chosen from, and ranges of names that are numbered apart.
SAMPLE, RANGES = 4096, 64


def series(samples: DataFrame) -> DataFrame:
    """Every series once, in order of its name: name, metric, labels."""
    return samples.groupBy(F.col("series").alias("name")).agg(F.first("metric").alias("metric"), F.first("labels").alias("labels"))


def with_ids(catalog: DataFrame, known: DataFrame | None = None, first: int = 1) -> DataFrame:
    """Adds series_id, from `first` on. Known series keep theirs; new ones follow the largest, in order of name. Numbers are counted per
    range of names first, so only the counts of the ranges meet in one place."""
    top = first - 1
    if known is not None:
        top = known.agg(F.max("series_id")).first()[0] or top
        old, catalog = catalog.join(known.select("name", "series_id"), "name"), catalog.join(known.select("name"), "name", "left_anti")
    # Bounds of the ranges, from a sample of names chosen by their hash: the same wherever they are used.
    some = sorted(r.name for r in catalog.select("name").orderBy(F.xxhash64("name"), "name").limit(SAMPLE).collect())
    bounds = F.array(*map(F.lit, some[:: max(1, len(some) // RANGES)])) if some else F.array().cast("array<string>")
    ranged = catalog.withColumn("part", F.size(F.filter(bounds, lambda b: b <= F.col("name"))))
    ranged = ranged.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy("name")))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    # A row for each range.
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    new = ranged.join(F.broadcast(before), "part").withColumn("series_id", F.lit(top).cast("long") + F.col("before") + F.col("own")).select(*catalog.columns, "series_id")
    return new if known is None else old.select(new.columns).unionByName(new)


def by_id(ids: DataFrame, series_id: int) -> DataFrame:
    """Name and labels of one series, the metric among the labels; no row if the id isn't known."""
    return ids.where(F.col("series_id") == series_id).select("series_id", "name", labels_column(F.col("name")).alias("labels"))


def by_name(ids: DataFrame, metric: str, labels: dict[str, str] | None = None) -> DataFrame:
    """The series with exactly these labels, whatever their order; no row if there is none."""
    return ids.where(F.col("name") == series_name(metric, labels))


def label_stats(catalog: DataFrame) -> DataFrame:
    """One row: series, label keys, and pairs of key and value; the metric counts as a label."""
    pairs = catalog.select(F.explode(F.map_concat("labels", F.create_map(F.lit("__name__"), "metric"))).alias("key", "value"))
    pairs = pairs.groupBy("key").agg(F.countDistinct("value").alias("values"))
    both = pairs.agg(F.count("*").alias("label_keys"), F.sum("values").alias("label_pairs"))
    n = catalog.agg(F.count("*").alias("series"))
    return n.withColumn("one", F.lit(1)).join(both.withColumn("one", F.lit(1)), "one").drop("one")


def zone_map(samples: DataFrame) -> DataFrame:
    """Least and largest time, and number of samples, of each series and block."""
    return samples.groupBy("series", "block_base").agg(F.min("t").alias("min_ts"), F.max("t").alias("max_ts"), F.count("*").alias("n"))


def overlapping(zones: DataFrame, start: int, end: int) -> DataFrame:
    return zones.where((F.col("max_ts") >= start) & (F.col("min_ts") <= end))


def split_blocks(samples: DataFrame, most: int = BLOCK_SAMPLES) -> DataFrame:
    """Adds part: a block's samples in order, cut after `most` of them."""
    order = Window.partitionBy("series", "block_base").orderBy("t", "seq")
    return samples.withColumn("part", F.floor((F.row_number().over(order) - 1) / most).cast("int"))


def high_water(samples: DataFrame, sealed: DataFrame) -> DataFrame:
    """Drops samples that aren't later than the last sealed one of their series."""
    marks = sealed.groupBy("series").agg(F.max("t").alias("mark"))
    return samples.join(marks, "series", "left").where("mark IS NULL OR t > mark").drop("mark")


def ingest_stats(samples: DataFrame) -> DataFrame:
    """One row: series, blocks, samples, bounds of time and value."""
    zones = samples.groupBy("series", "block_base").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"), largest(F.col("v")).alias("high"), smallest(F.col("v")).alias("low"))
    of_series = zones.groupBy("series").agg(F.count("*").alias("blocks"), F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"), F.max("high").alias("high"), F.min("low").alias("low"))
    return of_series.agg(F.count("*").alias("series"), F.sum("blocks").alias("sealed_blocks"), F.sum("n").alias("total_samples"), F.min("a").alias("min_ts"), F.max("b").alias("max_ts"), F.min("low").alias("min_v"), F.max("high").alias("max_v"))


def rebased(samples: DataFrame) -> DataFrame:
    return samples.withColumn("block_base", block_base(F.col("t")))
