import math

import pytest
from pyspark.sql import functions as F

from tidemark.engine import BodyTooLarge, Engine
from tidemark.operators import rules as R
from tidemark.operators.range_query import Query
from tidemark.operators.rules import AlertRule
from tidemark.sources import exposition, generators
from tidemark.sources.store import SampleTable
from tidemark.streaming import continuous, ingest

GOOD = '# HELP cpu_usage docs\n# TYPE cpu_usage gauge\n\ncpu_usage{host="a"} 42.5\ncpu_usage{host="b"} 7 1700000000000\nplain_metric 1\n'
BAD = "good 1\nnovalue\nbad notanumber\nbadts 3 notats\nnegts 3 -5\nalso_good 2"


def parsed(spark, body, **k):
    return exposition.parsed(exposition.lines_of(spark.createDataFrame([(body,)], "body string")), 123, **k)


def test_good_and_bad_lines(spark):
    got = exposition.good(parsed(spark, GOOD)).orderBy("seq").collect()
    assert [(r.series, r.t, r.v) for r in got] == [('cpu_usage{host="a"}', 123, 42.5), ('cpu_usage{host="b"}', 1_700_000_000, 7.0), ("plain_metric", 123, 1.0)]
    errors = [r.error for r in exposition.bad(parsed(spark, BAD)).orderBy("lineno").collect()]
    assert exposition.good(parsed(spark, BAD)).count() == 2 and len(errors) == 4
    assert "bad value" in errors[1] and "bad timestamp" in errors[2] and "positive" in errors[3]


def test_odd_lines(spark):
    body = 'm{a="x y", b="q\\"r"} 1\nm{a="1",a="2"} 2\nm +Inf\nm nan\nm 1e3 1999 extra\nm{a!="x"} 1\n9m 1\nm{a="1"} 1d\nm 1_000\nm{a="1" junk} 1\nm{} 1\r\nk .5\n'
    rows = parsed(spark, body).orderBy("lineno").collect()
    good = [(r.series, r.t, r.v) for r in rows if r.error is None]
    assert good[0] == ('m{a="x y",b="q\\"r"}', 123, 1.0) and good[1] == ('m{a="2"}', 123, 2.0)
    assert good[2][2] == math.inf and math.isnan(good[3][2]) and good[4] == ("m", 1, 1000.0) and good[5] == ("k", 123, 0.5)
    assert [r.lineno for r in rows if r.error] == [6, 7, 8, 9, 10, 11]
    assert parsed(spark, body, compat=True).orderBy("lineno").first().error.startswith("line 1: bad value")
    assert parsed(spark, "").count() == 0


def test_engine(spark, tmp_path):
    db = Engine(spark, f"{tmp_path}/samples")
    seen = []
    db.table.subscribe(lambda batch: seen.append(batch.count()))
    assert db.ingest('cpu{host="a"} 90 1000000\ncpu{host="a"} 70 1001000\nbroken\n', 5) == {"accepted": 2, "skipped": 1, "series": 1, "errors": ["line 3: expected metric and value"]}
    db.table.write('cpu{host="b"}', [1000, 1001], [1.0, float("inf")])
    assert seen == [2, 2]
    with pytest.raises(ValueError):
        db.table.write("cpu", [1, 2], [1.0])
    with pytest.raises(ValueError):
        db.table.write("cpu", [-1], [1.0])
    with pytest.raises(BodyTooLarge):
        db.ingest("x" * (9 << 20), 5)
    answer = db.query_json(Query("cpu", 0, 2000))
    assert answer["result"] == [{"name": 'cpu{host="a"}', "labels": {"__name__": "cpu", "host": "a"}, "points": [{"t": 1000, "v": 90.0}, {"t": 1001, "v": 70.0}]}, {"name": 'cpu{host="b"}', "labels": {"__name__": "cpu", "host": "b"}, "points": [{"t": 1000, "v": 1.0}, {"t": 1001, "v": "Infinity"}]}]
    assert [(r.series_id, r.name) for r in db.series().collect()] == [(1, 'cpu{host="a"}'), (2, 'cpu{host="b"}')]
    assert db.lookup("cpu", {"host": "b"}) == 2 and db.lookup("cpu") is None
    assert [(r.name, r.labels) for r in db.series_by_id(1).collect()] == [('cpu{host="a"}', {"__name__": "cpu", "host": "a"})] and db.series_by_id(9).count() == 0
    assert {r.v for r in db.latest("cpu", 1001).collect()} == {70.0, math.inf}
    db.rules.add(name="busy", metric="cpu", labels={"host": "a"}, window_sec=300, threshold=50)
    assert len(db.check_rules(1001)) == 1 and db.check_rules(1002) == [] and db.recent_alerts().count() == 1
    stats = db.stats()
    assert (stats["series"], stats["total_samples"], stats["rules_firing"], stats["fired_total"]) == (2, 4, 1, 1)
    db.table.write('aaa{x="1"}', [1000], [1.0])  # comes first by name, last by number
    assert [(r.series_id, r.name) for r in db.series().collect()] == [(1, 'cpu{host="a"}'), (2, 'cpu{host="b"}'), (3, 'aaa{x="1"}')]
    again = Engine(spark, f"{tmp_path}/samples")
    again.rules.add(name="busy", metric="cpu", labels={"host": "a"}, window_sec=300, threshold=50)
    assert again.check_rules(1002) == []  # it has been firing since before the restart
    assert again.lookup("aaa", {"x": "1"}) == 3
    db.rules.rules["r1"].threshold = "many"  # a rule that can't be evaluated any more
    db.rules.add(name="other", metric="cpu", labels={"host": "a"}, window_sec=300, threshold=50)
    assert [a["rule_id"] for a in db.check_rules(1002)] == ["r2"] and [e["rule_id"] for e in db.rule_errors] == ["r1"]
    assert db.stats()["rules_firing"] == 2  # what r1 fires for goes on
    db.rules.remove("r2")
    db.rules.remove("r1")
    assert db.check_rules(1003) == [] and db.stats()["rules_firing"] == 0


def test_compaction_keeps_rows(spark, tmp_path):
    table = SampleTable(spark, f"{tmp_path}/samples")
    for k in range(4):
        table.write("m", [k, 7200 + k], [float(k), 1.0])
    before = sorted(map(str, table.read().collect()))
    table.compact(0)
    assert sorted(map(str, table.read().collect())) == before
    assert len(list((tmp_path / "samples" / "block_base=0").glob("*.parquet"))) == 1 and len(list((tmp_path / "samples" / "block_base=7200").glob("*.parquet"))) == 4


def test_compaction_keeps_what_is_appended_meanwhile(spark, tmp_path, monkeypatch):
    table = SampleTable(spark, f"{tmp_path}/samples")
    for k in range(3):
        table.write("m", [k], [float(k)])
    from tidemark.sources import store

    whole, late = store.Files.names, []

    def names(self):
        out = whole(self)
        if not late:  # an append between the listing and the exchange
            late.append(1)
            table.write("m", [100], [100.0])
        return out

    monkeypatch.setattr(store.Files, "names", names)
    table.compact(0)
    monkeypatch.undo()
    assert sorted(r.t for r in table.read().collect()) == [0, 1, 2, 100]


def test_rules_read_their_window_only(spark, tmp_path):
    table = SampleTable(spark, f"{tmp_path}/samples")
    table.write("cpu", [1000, 8000, 100_000], [90.0, 1.0, 60.0])
    values = R.rule_values(table.read(), R.rules_frame(spark, [AlertRule("r", "n", "cpu", window_sec=300)]), 100_100)
    assert [r.value for r in values.collect()] == [60.0]
    plan = values._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pruned = [line for line in plan.splitlines() if "PartitionFilters: [" in line]
    assert pruned and all("block_base" in line and "93600" in line for line in pruned), plan
    assert "GreaterThanOrEqual(t,99800)" in plan and "EqualTo(metric,cpu)" in plan, plan


def test_one_block_is_written_by_many_tasks(spark, tmp_path):
    rows = generators.hosts(spark, 40, 50).where("metric = 'cpu_usage'")
    table = SampleTable(spark, f"{tmp_path}/samples")
    table.append(rows)
    assert len(list((tmp_path / "samples").glob("block_base=*/*.parquet"))) > 1 and table.read().count() == 2000


def test_streaming_ingest_restarts_without_loss(spark, tmp_path):
    (tmp_path / "in").mkdir()
    errors = []
    run = lambda: ingest.start(spark, f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/ckpt", lambda rows, bad, n: errors.extend(r.error for r in bad.collect()), now=50, once=True).awaitTermination()
    (tmp_path / "in" / "a.txt").write_text('m{h="1"} 1\nm{h="1"} 2 9000000\noops\n')
    run()
    (tmp_path / "in" / "b.txt").write_text("m 3 5000\n")  # late: never dropped
    run()
    run()
    rows = sorted((r.series, r.t, r.v) for r in ingest.stored(spark, f"{tmp_path}/table").collect())
    assert rows == [("m", 5, 3.0), ('m{h="1"}', 50, 1.0), ('m{h="1"}', 9000, 2.0)] and errors == ["line 3: expected metric and value"]


def test_rollup_stream_equals_batch(spark, tmp_path):
    samples = generators.hosts(spark, 3, 400)
    samples.write.parquet(f"{tmp_path}/s")
    stream = continuous.rollup(continuous.sample_stream(spark, f"{tmp_path}/s"), 60, "1 minute")
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.series, r.t): r["count"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.series, r.b): r.n for r in samples.groupBy("series", (F.col("t") - F.pmod("t", F.lit(60))).alias("b")).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_watch(spark, tmp_path):
    table = SampleTable(spark, f"{tmp_path}/s")
    table.write("cpu", [1000], [90.0])
    (tmp_path / "tick").mkdir()
    fired = []
    firing = continuous.Firing(spark, f"{tmp_path}/firing")
    rules = [AlertRule("r1", "busy", "cpu", window_sec=300, threshold=50)]

    def run(now):
        (tmp_path / "tick" / f"{now}.txt").write_text("x")
        continuous.watch(spark.readStream.text(f"{tmp_path}/tick"), table.read, lambda: R.rules_frame(spark, rules), firing, lambda n: now, lambda a, n: fired.extend(r.series for r in a.collect()), f"{tmp_path}/c", once=True).awaitTermination()

    run(1000)
    firing = continuous.Firing(spark, f"{tmp_path}/firing")  # a restart: what fires is read from the folder
    run(1001)
    assert fired == ["cpu"] and firing.read().count() == 1
    run(5000)  # silent for long: resolves
    assert fired == ["cpu"] and firing.read().count() == 0
