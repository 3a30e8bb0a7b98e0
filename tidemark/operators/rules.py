"""Threshold rules: their values, edge-triggered alerts, and the set of what is firing.

All rules are evaluated in one job. A rule's value is the aggregate over the last epoch-aligned bucket of its window
within [now - window, now + 1]; its sample count is that of the whole range (mode "bucket"). Mode "rolling" aggregates
over the whole range instead.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.samples import aggregate, block_base, bucket, compare
from tidemark.model import ALERTS, COMPARATORS, FIRING, RECENT_ALERTS, RULE_AGGREGATES, RULES


#: What a rule must meet, for a rule in Python and for a row of a table.
DEMANDS = (
    ("comparator must be one of " + " ".join(COMPARATORS), lambda r: r.op in COMPARATORS, lambda: F.col("op").isin(*COMPARATORS)),
    ("aggregate must be one of " + " ".join(RULE_AGGREGATES), lambda r: r.agg in RULE_AGGREGATES, lambda: F.col("agg").isin(*RULE_AGGREGATES)),
    ("window_sec must be > 0", lambda r: r.window_sec > 0, lambda: F.col("window_sec") > 0),
    ("min_count must be >= 1", lambda r: r.min_count >= 1, lambda: F.col("min_count") >= 1),
    ("threshold must be a number", lambda r: r.threshold is not None, lambda: F.col("threshold").isNotNull()),
)


@dataclass
class AlertRule:
    id: str
    name: str
    metric: str
    labels: dict[str, str] = field(default_factory=dict)
    agg: str = "avg"
    window_sec: int = 60
    op: str = ">"
    threshold: float = 0.0
    min_count: int = 1
    enabled: bool = True
    created_at: int = 0

    def __post_init__(self) -> None:
        self.threshold = float(self.threshold)
        for message, holds, _ in DEMANDS:
            if not holds(self):
                raise ValueError(f"{message}: {self}")

    def as_dict(self) -> dict:
        camel = {"window_sec": "windowSec", "min_count": "minCount", "created_at": "createdAt"}
        return {camel.get(k, k): v for k, v in asdict(self).items()}


class RuleSet:
    """Rules in order of insertion; ids are given as the lowest free rN."""

    def __init__(self) -> None:
        self.rules: dict[str, AlertRule] = {}

    def add(self, **spec) -> AlertRule:
        number = 1
        while not spec.get("id") and f"r{number}" in self.rules:
            number += 1
        rule = AlertRule(**spec | {"id": spec.get("id") or f"r{number}"})
        if rule.id in self.rules:
            raise KeyError(f"rule {rule.id!r} already exists")
        self.rules[rule.id] = rule
        return rule

    def remove(self, rule_id: str) -> bool:
        return self.rules.pop(rule_id, None) is not None

    def frame(self, spark: SparkSession) -> DataFrame:
        return rules_frame(spark, list(self.rules.values()))

    def stats(self) -> dict[str, int]:
        return {"rules": len(self.rules), "enabled": sum(r.enabled for r in self.rules.values())}


def rules_frame(spark: SparkSession, rules: list[AlertRule]) -> DataFrame:
    """Rules as rows. A rule changed into something that no row can hold becomes a row that `rejected` names."""

    def row(r: AlertRule) -> tuple:
        known = {"window_sec": int, "threshold": float, "min_count": int, "created_at": int, "enabled": bool}
        out = asdict(r)
        for name, kind in known.items():
            try:
                out[name] = kind(out[name])
            except (TypeError, ValueError):
                out[name] = None
        return tuple(True if name == "enabled" and value is None else value for name, value in out.items())

    return spark.createDataFrame([row(r) for r in rules], RULES)


def usable(rules: DataFrame) -> DataFrame:
    return rules.where(functools.reduce(Column.__and__, (F.coalesce(holds(), F.lit(False)) for _, _, holds in DEMANDS)))


def rejected(rules: DataFrame) -> DataFrame:
    """rule_id and reason of the rules that can't be evaluated; they disturb no other rule."""
    reason = F.coalesce(*(F.when(~F.coalesce(holds(), F.lit(False)), F.lit(message)) for message, _, holds in DEMANDS))
    return rules.select(F.col("id").alias("rule_id"), reason.alias("reason")).where("reason IS NOT NULL")


def in_windows(samples: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """The samples that any rule may look at: bounds on time, block and metric that reach the scan. Rules are a handful."""
    few = rules.select("metric", "window_sec").distinct().collect()
    if not few:
        return samples.limit(0)
    first, last = now - max(r.window_sec for r in few), now + 1
    return samples.where(F.col("t").between(first, last) & F.col("block_base").between(block_base(F.lit(first)), block_base(F.lit(last))) & F.col("metric").isin(sorted({r.metric for r in few})))


def selects(labels: Column, needs: Column, absent: Column) -> Column:
    """Whether a series has all labels of a rule: the pairs in needs, and nothing under the keys in absent."""
    has = F.map_filter(labels, lambda _, v: v != "")
    return (F.size(F.array_except(needs, F.map_entries(labels))) == 0) & (F.size(F.array_intersect(absent, F.map_keys(has))) == 0)


def rule_values(samples: DataFrame, rules: DataFrame, now: int, mode: str = "bucket", seq_follows_time: bool = False) -> DataFrame:
    """rule_id, series, labels, value and samples of every enabled rule and series with samples in its window. rules is
    a handful of rows that users typed, so every task gets them; each aggregate is made once, whichever rule needs it."""
    rules = usable(rules).where("enabled")
    samples = in_windows(samples, rules, now)
    r = rules.select(F.col("id").alias("rule_id"), F.col("metric").alias("rule_metric"), F.filter(F.map_entries("labels"), lambda e: e["value"] != "").alias("needs"), F.map_keys(F.map_filter("labels", lambda _, v: v == "")).alias("absent"), "agg", F.col("window_sec").cast("long").alias("w"))
    longest = F.broadcast(r)
    rows = samples.join(longest, (F.col("metric") == F.col("rule_metric")) & F.col("t").between(F.lit(now) - F.col("w"), F.lit(now + 1)) & selects(F.col("labels"), F.col("needs"), F.col("absent")))
    # A window of one second asks for the samples themselves, whatever the aggregate: the last one counts.
    rows = rows.withColumn("bucket", F.when((F.col("w") <= 1) | F.lit(mode == "rolling"), F.lit(0).cast("long")).otherwise(bucket(F.col("t"), F.col("w"))))
    order = F.col("seq") if seq_follows_time else F.struct("t", "seq")
    each = rows.groupBy("rule_id", "agg", "w", "series", "bucket").agg(*(aggregate(a, F.col("v"), order).alias(a) for a in RULE_AGGREGATES), F.count("*").alias("n"), F.first("labels").alias("labels"))
    chosen = F.when((F.col("w") <= 1) & F.lit(mode == "bucket"), F.col("last"))
    for a in RULE_AGGREGATES:
        chosen = chosen.when(F.col("agg") == a, F.col(a))
    each = each.withColumn("value", chosen)
    return each.groupBy("rule_id", "series").agg(F.max_by("value", "bucket").alias("value"), F.sum("n").alias("samples"), F.first("labels").alias("labels"))


def active(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Values that meet their rule, and have as many samples as it asks for."""
    r = F.broadcast(usable(rules).where("enabled").select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "metric", "agg", "window_sec", "op", "threshold", "min_count"))
    return values.join(r, "rule_id").where((F.col("samples") >= F.col("min_count")) & compare(F.col("value"), F.col("op"), F.col("threshold")))


@F.pandas_udf(StringType())
def alert_message(name: pd.Series, agg: pd.Series, metric: pd.Series, window: pd.Series, value: pd.Series, op: pd.Series, threshold: pd.Series) -> pd.Series:
    """C-style %g, which the JVM's formatter doesn't have; alerts are few."""
    rows = zip(name, agg, metric, window, value, op, threshold, strict=True)
    return pd.Series([f"{n}: {a}({m}) over {w}s is {v:.4g}, expected {o} {t:g}" for n, a, m, w, v, o, t in rows], dtype=object)


def evaluate(samples: DataFrame, rules: DataFrame, firing: DataFrame, now: int, mode: str = "bucket", seq_follows_time: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Alerts, what fires now, and what has resolved. Only a change into firing alerts. What isn't active any more, has
    too few samples or none, or belongs to a disabled or removed rule resolves, and may fire again later. A rule that
    can't be evaluated (see `rejected`) changes nothing: what it fires for goes on, and the other rules go their way."""
    stuck = rejected(rules.where("enabled")).select("rule_id")
    on = active(rule_values(samples, rules, now, mode, seq_follows_time), rules)
    keys = ["rule_id", "series"]
    new = on.join(firing.select(*keys), keys, "left_anti")
    message = alert_message("rule_name", "agg", "metric", "window_sec", "value", "op", "threshold")
    alerts = new.select("rule_id", "rule_name", "metric", "series", "labels", "value", "threshold", "op", F.lit(now).cast("long").alias("fired_at"), message.alias("message"))
    now_firing = on.select(*keys).unionByName(firing.select(*keys).join(F.broadcast(stuck), "rule_id", "left_semi"))
    return alerts, now_firing, firing.select(*keys).join(now_firing, keys, "left_anti")


def replay_edges(flags: DataFrame, keys: list[str], tick: str) -> DataFrame:
    """Of rows of keys, tick and active: the ticks that alert. A tick without a row resolves."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(tick)
    before = F.coalesce(F.lag("active").over(w) & (F.lag(tick).over(w) == F.col(tick) - 1), F.lit(False))
    return flags.withColumn("before", before).where("active AND NOT before").drop("before")


def recent(alerts: DataFrame, most: int = RECENT_ALERTS) -> DataFrame:
    """The newest alerts first."""
    return alerts.orderBy(F.desc("fired_at"), "rule_id", "series").limit(most)


def as_json(alerts: DataFrame) -> DataFrame:
    names = {"rule_id": "ruleId", "rule_name": "ruleName", "fired_at": "firedAt"}
    fields = [F.col(c).alias(names.get(c, c)) for c in alerts.columns]
    return alerts.select(F.to_json(F.struct(*fields)).alias("json"))


def empty_firing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FIRING)


def empty_alerts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ALERTS)


def rules_from_json(text: str) -> Iterator[AlertRule]:
    """Rules of a JSON list with the names that as_dict gives."""
    plain = {"windowSec": "window_sec", "minCount": "min_count", "createdAt": "created_at"}
    for spec in json.loads(text):
        yield AlertRule(**{plain.get(k, k): v for k, v in spec.items()})


__all__ = ["AlertRule", "RuleSet", "active", "alert_message", "as_json", "empty_alerts", "empty_firing", "evaluate", "recent", "rejected", "replay_edges", "rule_values", "rules_frame", "rules_from_json", "usable"]
