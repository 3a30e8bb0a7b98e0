import pytest

from tidemark.operators import rules as R
from tidemark.operators.rules import AlertRule

SCHEMA = "metric string, series string, labels map<string,string>, t long, v double, seq long, block_base long"


def samples(spark, rows):
    return spark.createDataFrame([("cpu", f'cpu{{host="{h}"}}', {"host": h}, t, float(v), i, 0) for i, (h, t, v) in enumerate(rows)], SCHEMA)


def run(spark, rows, rules, now, firing=None, **options):
    alerts, on, off = R.evaluate(samples(spark, rows), R.rules_frame(spark, rules), firing if firing is not None else R.empty_firing(spark), now, **options)
    return sorted((a.rule_id, a.series, a.message) for a in alerts.collect()), on, sorted(tuple(r) for r in off.collect())


def test_edges(spark):
    rule = AlertRule("r1", "busy", "cpu", window_sec=300, threshold=50)
    rows = [("a", 1000, 90), ("b", 1000, 10)]
    fired, on, _ = run(spark, rows, [rule], 1000)
    assert fired == [("r1", 'cpu{host="a"}', "busy: avg(cpu) over 300s is 90, expected > 50")]
    on = spark.createDataFrame(on.collect(), on.schema)
    again, _, off = run(spark, rows, [rule], 1001, on)
    assert again == [] and off == []
    for other, change in ([("a", 1000, 20)], {}), (rows[1:], {}), (rows, {"enabled": False}), (rows, {"min_count": 2}):
        fired, still, off = run(spark, other, [AlertRule("r1", "busy", "cpu", window_sec=300, threshold=50, **change)], 1002, on)
        assert fired == [] and still.count() == 0 and off == [("r1", 'cpu{host="a"}')]
    fired, _, off = run(spark, rows, [], 1003, on)
    assert off == [("r1", 'cpu{host="a"}')]


def test_value_of_last_bucket_and_whole_count(spark):
    rows = [("a", t, v) for t, v in [(941, 100), (959, 100), (960, 2), (1001, 4)]]  # buckets 900 and 960
    values = lambda mode, **k: [(r.value, r.samples) for r in R.rule_values(samples(spark, rows), R.rules_frame(spark, [AlertRule("r", "n", "cpu", window_sec=60, **k)]), 1000, mode).collect()]
    assert values("bucket") == [(3.0, 4)] and values("rolling") == [(51.5, 4)]
    assert values("bucket", agg="count") == [(2.0, 4)] and values("bucket", agg="max") == [(4.0, 4)]
    one = R.rules_frame(spark, [AlertRule("r", "n", "cpu", window_sec=1, agg="count")])
    assert [(r.value, r.samples) for r in R.rule_values(samples(spark, [("a", 999, 7), ("a", 1001, 8)]), one, 1000).collect()] == [(8.0, 2)]


def test_labels_choose_series(spark):
    rows = [("a", 1000, 90), ("b", 1000, 90)]
    fired, _, _ = run(spark, rows, [AlertRule("r1", "x", "cpu", {"host": "b"}), AlertRule("r2", "y", "cpu", {"absent": ""}), AlertRule("r3", "z", "mem")], 1000)
    assert [f[:2] for f in fired] == [("r1", 'cpu{host="b"}'), ("r2", 'cpu{host="a"}'), ("r2", 'cpu{host="b"}')]


def test_rule_set():
    rules = R.RuleSet()
    assert rules.add(name="x", metric="m").id == "r1" and rules.add(name="x", metric="m").id == "r2"
    rules.remove("r1")
    assert rules.add(name="x", metric="m").id == "r1" and not rules.remove("r9")
    with pytest.raises(KeyError):
        rules.add(id="r1", name="x", metric="m")
    for bad in ({"op": "~="}, {"agg": "first"}, {"window_sec": 0}, {"min_count": 0}):
        with pytest.raises(ValueError):
            rules.add(name="x", metric="m", **bad)
    import json

    rule = AlertRule("r", "n", "m", {"a": "b"}, min_count=3)
    assert list(R.rules_from_json(json.dumps([rule.as_dict()]))) == [rule]


def test_recent(spark):
    alerts = spark.createDataFrame([("r", "n", "m", f"s{i:03}", {}, 1.0, 0.0, ">", i // 2, "") for i in range(500)], R.empty_alerts(spark).schema)
    got = [r.fired_at for r in R.recent(alerts).collect()]
    assert len(got) == 200 and got == sorted(got, reverse=True) and got[0] == 249
    assert '"ruleId":"r"' in R.as_json(alerts).first().json
