"""One object for the whole of it: writes, queries, rules and statistics over a stored sample table."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import ERRORS_SHOWN
from tidemark.operators import catalog, range_query, rules
from tidemark.operators.range_query import Query
from tidemark.sources import exposition
from tidemark.sources.store import SampleTable, SeriesNumbers
from tidemark.streaming.continuous import Firing

BODY_BYTES = 8 << 20


class BodyTooLarge(ValueError):
    pass


class Engine:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table, self.rules = spark, SampleTable(spark, path), rules.RuleSet()
        self.numbers = SeriesNumbers(self.table)
        self.rule_errors: list[dict[str, str]] = []
        self.firing, self.alerts = Firing(spark, f"{self.table.path}__firing"), rules.empty_alerts(spark)
        self.counters = dict.fromkeys(("writes", "samples_received", "queries", "samples_read", "evaluations", "fired_total"), 0)

    def ingest(self, body: str, now: int) -> dict[str, Any]:
        """Stores the good lines of one body in a single batch and reports the first errors. A body that is too large is
        refused as a whole."""
        if len(body.encode()) > BODY_BYTES:
            raise BodyTooLarge(f"more than {BODY_BYTES} bytes")
        rows = exposition.parsed(exposition.lines_of(self.spark.createDataFrame([(body,)], "body string")), now).cache()
        good = exposition.good(rows)
        accepted, series = good.agg(F.count("*"), F.countDistinct("series")).first()
        if accepted:
            self.table.append(good)
        errors = [r.error for r in exposition.bad(rows).orderBy("lineno").limit(ERRORS_SHOWN).collect()]
        skipped = exposition.bad(rows).count()
        rows.unpersist()
        self.counters["writes"] += 1
        self.counters["samples_received"] += accepted
        return {"accepted": accepted, "skipped": skipped, "series": series, "errors": errors}

    def query(self, q: Query) -> DataFrame:
        self.counters["queries"] += 1
        return range_query.range_query(self.table.read(), q)

    def query_json(self, q: Query) -> dict[str, Any]:
        """One answer as plain values, series in order of their numbers; numbers that JSON doesn't know are texts. It
        comes to the driver whole, for an answer that one client reads; `query` gives it as rows."""
        points = range_query.ordered(range_query.nested(self.query(q)), self.numbers.current()).collect()
        plain = lambda v: v if math.isfinite(v) else "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
        result = [{"name": r.series, "labels": dict(r.labels), "points": [{"t": p.t, "v": plain(p.v)} for p in r.points]} for r in points]
        self.counters["samples_read"] += sum(len(r["points"]) for r in result)
        return {"metric": q.metric, "agg": q.agg, "step": q.step, "start": q.start, "end": q.end, "result": result}

    def latest(self, metric: str, now: int, window: int = range_query.LATEST_WINDOW) -> DataFrame:
        return range_query.latest(self.table.read(), metric, now, window)

    def series(self) -> DataFrame:
        """All series with their lasting numbers."""
        return self.numbers.current().orderBy("series_id")

    def series_by_id(self, series_id: int) -> DataFrame:
        return catalog.by_id(self.numbers.current(), series_id)

    def lookup(self, metric: str, labels: dict[str, str] | None = None) -> int | None:
        """The number of the series with exactly these labels."""
        found = catalog.by_name(self.numbers.current(), metric, labels).first()
        return found.series_id if found else None

    def check_rules(self, now: int) -> list[dict[str, Any]]:
        """Evaluates all rules. New alerts are few and come back as plain values; what fires is a stored table, which a
        restart finds again."""
        number = (self.firing.last() or 0) + 1
        if not self.rules.rules:
            self.firing.write(rules.empty_firing(self.spark), number)
            return []
        frame = self.rules.frame(self.spark)
        self.rule_errors = [r.asDict() for r in rules.rejected(frame.where("enabled")).collect()]
        new, firing, _ = rules.evaluate(self.table.read(), frame, self.firing.read(), now)
        rows = new.collect()
        self.firing.write(firing, number)
        # The recent alerts are few; a small frame without a history keeps later checks short.
        self.alerts = self.spark.createDataFrame([*rows, *rules.recent(self.alerts).collect()], self.alerts.schema)
        self.counters["evaluations"] += 1
        self.counters["fired_total"] += len(rows)
        return [r.asDict() for r in rows]

    def recent_alerts(self) -> DataFrame:
        return rules.recent(self.alerts)

    def stats(self) -> dict[str, Any]:
        stored = catalog.ingest_stats(self.table.read()).first().asDict()
        return stored | self.counters | {f"rules_{k}": v for k, v in self.rules.stats().items()} | {"rules_firing": self.firing.read().count(), "rules_alerts": self.alerts.count()}
