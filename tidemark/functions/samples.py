"""Scalar expressions over samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import BLOCK_SPAN, COMPARATORS

INFINITY = float("inf")


def bucket(t: Column, step: int | Column) -> Column:
    """Start of the epoch-aligned bucket of t; before the epoch too."""
    return t - F.pmod(t, step if isinstance(step, Column) else F.lit(step))


def block_base(t: Column) -> Column:
    return F.when(t < 0, F.lit(0).cast("long")).otherwise(bucket(t, BLOCK_SPAN).cast("long"))


def seconds(ts: Column) -> Column:
    """Whole seconds since the epoch of a TIMESTAMP_NTZ, whatever the session's time zone."""
    return F.unix_timestamp(ts)


def largest(v: Column) -> Column:
    """NaN is ignored; a group of nothing else gives -inf."""
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), F.lit(-INFINITY))


def smallest(v: Column) -> Column:
    return F.coalesce(F.min(F.when(~F.isnan(v), v)), F.lit(INFINITY))


def aggregate(agg: str, v: Column, order: Column, sequential: bool = False) -> Column:
    """One of the seven aggregates of v. order sorts equal groups of samples by time, then arrival. sequential: sums add
    up in that order, so their last bits don't hang on partitions; costs a sort of each group in memory."""
    if agg in ("avg", "sum") and sequential:
        in_order = F.array_sort(F.collect_list(F.struct(order.alias("o"), v.alias("v"))))
        total = F.aggregate(in_order, F.lit(0.0), lambda a, x: a + x["v"])
        return total if agg == "sum" else total / F.count(F.lit(1))
    return {"avg": F.avg, "sum": F.sum, "max": largest, "min": smallest, "first": lambda c: F.min_by(c, order), "last": lambda c: F.max_by(c, order), "count": lambda c: F.count(F.lit(1)).cast("double")}[agg](v)


def compare(value: Column, op: Column, threshold: Column) -> Column:
    """IEEE comparison: with NaN only != holds."""
    number = ~F.isnan(value) & ~F.isnan(threshold)
    out = F.when(op == "!=", ~number | (value != threshold))
    for name, holds in ((">", value > threshold), ("<", value < threshold), (">=", value >= threshold), ("<=", value <= threshold), ("==", value == threshold)):
        assert name in COMPARATORS
        out = out.when(op == name, number & holds)
    return out


def zigzag(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1).cast("long"))))
