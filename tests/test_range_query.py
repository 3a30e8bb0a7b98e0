import math
import random

import pytest

from tidemark.model import AGGREGATES
from tidemark.operators import catalog
from tidemark.operators import range_query as rq
from tidemark.operators.range_query import Query

BASE = 1_700_000_000
SCHEMA = "metric string, series string, labels map<string,string>, t long, v double, seq long, block_base long"


def frame(spark, points, series="m", labels=None):
    rows = [("m", series, labels or {}, t, float(v), i, max(0, t) // 7200 * 7200) for i, (t, v) in enumerate(points)]
    return spark.createDataFrame(rows, SCHEMA)


def points(df):
    return sorted((r.t, r.v) for r in df.collect())


@pytest.mark.parametrize(("agg", "want"), [("avg", [3, 6]), ("max", [5, 9]), ("min", [1, 3]), ("sum", [6, 12]), ("first", [1, 3]), ("last", [5, 9]), ("count", [2, 2])])
def test_aggregates(spark, agg, want):
    df = frame(spark, enumerate([1, 5, 3, 9]))
    for options in ({}, {"seq_follows_time": True}, {"sequential": True}):
        assert points(rq.range_query(df, Query("m", 0, 3, step=2, agg=agg), **options)) == [(0, want[0]), (2, want[1])]


def test_alignment_and_bounds(spark):
    df = frame(spark, [(BASE + i, i) for i in range(120)])
    assert points(rq.range_query(df, Query("m", BASE, BASE + 119, step=60))) == [(BASE - 20, 19.5), (BASE + 40, 69.5), (BASE + 100, 109.5)]
    assert points(rq.range_query(df, Query("m", BASE + 3, BASE + 5))) == [(BASE + 3, 3), (BASE + 4, 4), (BASE + 5, 5)]
    assert rq.range_query(df, Query("cpu", BASE, BASE + 9)).count() == 0


def test_identity_keeps_equal_seconds(spark):
    df = frame(spark, [(5, 1), (5, 2), (5, 1)])
    for step in (0, 1):
        assert points(rq.range_query(df, Query("m", 0, 9, step=step, agg="count"))) == [(5, 1), (5, 1), (5, 2)]
    assert points(rq.latest(df, "m", 9)) == [(5, 1)]
    assert [tuple(p) for p in rq.nested(rq.range_query(df, Query("m", 0, 9))).first().points] == [(5, 1), (5, 2), (5, 1)]
    assert '"name":"m"' in rq.as_json(rq.range_query(df, Query("m", 0, 9))).first().json


def test_errors():
    for bad in ({"start": 10, "end": 5}, {"agg": "median"}, {"step": -1}):
        with pytest.raises(ValueError):
            Query(**{"metric": "m", "start": 0, "end": 9} | bad)


def brute(given, step, agg):
    groups = {}
    for t, v in sorted(given, key=lambda p: p[0]):
        groups.setdefault(t - t % step, []).append(v)
    real = lambda vs: [v for v in vs if not math.isnan(v)]
    f = {"avg": lambda v: sum(v) / len(v), "sum": sum, "max": lambda v: max(real(v), default=-math.inf), "min": lambda v: min(real(v), default=math.inf), "first": lambda v: v[0], "last": lambda v: v[-1], "count": lambda v: float(len(v))}[agg]
    return [(t, f(v)) for t, v in sorted(groups.items())]


@pytest.mark.parametrize("agg", AGGREGATES)
def test_odd_values_against_brute_force(spark, agg):
    rng = random.Random(7)
    odd = [math.nan, math.inf, -math.inf, -0.0, 0.0, 5e-324, 1e300]
    given = [(rng.randint(-50, 50), rng.choice(odd) if rng.random() < 0.4 else rng.uniform(-9, 9)) for _ in range(300)]
    rows = [("m", "m", {}, t, v, i, max(0, t) // 7200 * 7200) for i, (t, v) in enumerate(given)]
    got = points(rq.range_query(spark.createDataFrame(rows, SCHEMA), Query("m", -50, 50, step=7, agg=agg), sequential=True))
    same = lambda a, b: a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-12)
    want = brute(given, 7, agg)
    assert [t for t, _ in got] == [t for t, _ in want] and all(same(a, b) for (_, a), (_, b) in zip(got, want))


def test_labels_and_groups(spark):
    a, b = ([(i, k) for i in range(10)] for k in (1, 2))
    df = frame(spark, a, 'm{host="a"}', {"host": "a"}).union(frame(spark, b, 'm{host="b"}', {"host": "b"}))
    assert {r.v for r in rq.range_query(df, Query("m", 0, 9, labels={"host": "b"})).collect()} == {2.0}
    assert [(r.host, r.v) for r in rq.range_query(df, Query("m", 0, 9, step=60, agg="sum", by=["host"])).orderBy("host").collect()] == [("a", 10.0), ("b", 20.0)]
    names = catalog.with_ids(catalog.series(df)).orderBy("series_id").collect()
    assert [(r.series_id, r.name) for r in names] == [(1, 'm{host="a"}'), (2, 'm{host="b"}')]
    more = catalog.series(df.union(frame(spark, a, "k")))
    again = {r.name: r.series_id for r in catalog.with_ids(more, spark.createDataFrame(names)).collect()}
    assert again == {'m{host="a"}': 1, 'm{host="b"}': 2, "k": 3}
    stats = catalog.label_stats(catalog.series(df)).first()
    assert (stats.series, stats.label_keys, stats.label_pairs) == (2, 2, 3)


def test_high_water_and_overlap(spark):
    df = frame(spark, [(i, i) for i in range(100)])
    kept = catalog.high_water(df, df.where("t < 50"))
    assert sorted(r.t for r in kept.collect()) == list(range(50, 100))
    zones = catalog.zone_map(frame(spark, [(0, 1), (7199, 1), (7200, 1), (20_000, 1)]))
    assert {(r.block_base, r.min_ts, r.max_ts, r.n) for r in zones.collect()} == {(0, 0, 7199, 2), (7200, 7200, 7200, 1), (14400, 20_000, 20_000, 1)}
    assert catalog.overlapping(zones, 7199, 7200).count() == 2


def test_pushdown(spark):
    from tidemark.sources import tables

    plan = rq.range_query(tables.events(spark, "/root/testdata/sf0.001", BASE, BASE + 9), Query("event_value", BASE, BASE + 9, step=60))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan and "props" not in plan
