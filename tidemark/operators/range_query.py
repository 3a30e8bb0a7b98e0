"""Range queries: matchers, an inclusive range of seconds, and epoch-aligned buckets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.samples import aggregate, block_base, bucket
from tidemark.functions.selector import Matcher, equalities, labels_column, matches, parse_selector
from tidemark.model import AGGREGATES

LATEST_WINDOW = 300


@dataclass
class Query:
    """step 0 and 1 return the samples themselves, whatever agg is. `by`: aggregate over all series that share these
    labels; without it each series stays alone."""

    metric: str
    start: int
    end: int
    labels: dict[str, str] | None = None
    step: int = 0
    agg: str = "avg"
    matchers: list[Matcher] = field(default_factory=list)
    by: list[str] | None = None

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise ValueError("start must be <= end")
        if self.agg not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.agg!r}")
        if self.step < 0:
            raise ValueError("step must be >= 0")

    @classmethod
    def of(cls, selector: str, start: int, end: int, step: int = 0, agg: str = "avg", by: list[str] | None = None) -> Query:
        metric, matchers = parse_selector(selector)
        return cls(metric, start, end, None, step, agg, matchers, by)


def selected(samples: DataFrame, q: Query) -> DataFrame:
    """The samples that a query reads. The bounds on block_base prune partitions of a stored table."""
    first, last = block_base(F.lit(q.start)), block_base(F.lit(q.end))
    return samples.where((F.col("metric") == q.metric) & matches(F.col("labels"), [*equalities(q.labels), *q.matchers]) & F.col("t").between(q.start, q.end) & F.col("block_base").between(first, last))


def time_order(seq_follows_time: bool) -> Column:
    """What sorts a group by time, then arrival. Where seq already follows time it's enough alone, and first and last stay in a hash aggregate."""
    return F.col("seq") if seq_follows_time else F.struct("t", "seq")


def range_query(samples: DataFrame, q: Query, seq_follows_time: bool = False, sequential: bool = False) -> DataFrame:
    """series (or the `by` labels), t and v. A bucket's t may lie before start; empty buckets have no row."""
    rows = selected(samples, q)
    keys = ["series"] if q.by is None else list(q.by)
    if q.by is not None:
        rows = rows.withColumns({name: F.coalesce(F.try_element_at("labels", F.lit(name)), F.lit("")) for name in q.by})
    if q.step <= 1:
        return rows.select(*keys, "t", "v", "seq")
    value = aggregate(q.agg, F.col("v"), time_order(seq_follows_time), sequential)
    return rows.groupBy(*keys, bucket(F.col("t"), q.step).alias("bucket")).agg(value.alias("v")).select(*keys, F.col("bucket").alias("t"), "v")


def latest(samples: DataFrame, metric: str, now: int, window: int = LATEST_WINDOW, seq_follows_time: bool = False) -> DataFrame:
    """Each series' last sample in [now - window, now + 1]."""
    rows = selected(samples, Query(metric, now - window, now + 1))
    order = time_order(seq_follows_time)
    return rows.groupBy("series").agg(F.max_by("t", order).alias("t"), F.max_by("v", order).alias("v"))


def with_labels(result: DataFrame) -> DataFrame:
    """Adds labels, the metric among them, to rows of series. They are read from the canonical name of the few rows of an
    answer, so nothing is joined or grouped for them."""
    return result.withColumn("labels", labels_column(F.col("series")))


def ordered(result: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """In order of series (by id, where rows of series_id and name are given), time and arrival."""
    if ids is None:
        return result.orderBy("series", *(c for c in ("t", "seq") if c in result.columns))
    numbered = result.join(ids.select(F.col("name").alias("series"), "series_id"), "series")
    return numbered.orderBy("series_id", *(c for c in ("t", "seq") if c in result.columns))


def nested(result: DataFrame) -> DataFrame:
    """series, labels and points: one row for each series, its points in order of time. A series' points of one answer
    must fit into memory; nested_blocks has no such bound."""
    order = [c for c in ("t", "seq", "v") if c in result.columns]
    points = F.array_sort(F.collect_list(F.struct(*order)))
    out = result.groupBy("series").agg(F.transform(points, lambda p: F.struct(p["t"].alias("t"), p["v"].alias("v"))).alias("points"))
    return with_labels(out).select("series", "labels", "points")


def nested_blocks(result: DataFrame) -> DataFrame:
    """The same with a row for each series and block of time, in whose order the points of a series follow one another."""
    order = [c for c in ("t", "seq", "v") if c in result.columns]
    points = F.array_sort(F.collect_list(F.struct(*order)))
    out = result.groupBy("series", block_base(F.col("t")).alias("block_base")).agg(F.transform(points, lambda p: F.struct(p["t"].alias("t"), p["v"].alias("v"))).alias("points"))
    return with_labels(out).select("series", "labels", "block_base", "points")


def as_json(result: DataFrame) -> DataFrame:
    return nested(result).select("series", F.to_json(F.struct(F.col("series").alias("name"), "labels", "points")).alias("json"))
