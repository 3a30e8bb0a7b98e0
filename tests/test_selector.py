import pytest
from pyspark.sql import functions as F

from tidemark.functions import selector as s
from tidemark.functions.samples import block_base, compare, unzigzag, zigzag
from tidemark.operators.range_query import Query, selected


def sample_rows(spark):
    rows = [("cpu", {"host": "a", "job": "web"}), ("cpu", {"host": "b", "job": "db"}), ("mem", {"host": "a"}), ("cpu", {})]
    df = spark.createDataFrame([(m, labels, 5, 1.0, i, 0) for i, (m, labels) in enumerate(rows)], "metric string, labels map<string,string>, t long, v double, seq long, block_base long")
    return df.withColumn("series", s.series_column(F.col("metric"), F.col("labels")))


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("cpu", {0, 1, 3}),
        ("mem", {2}),
        ('cpu{host="a"}', {0}),
        ('cpu{host!="a"}', {1, 3}),
        ('cpu{host=~"a|b"}', {0, 1}),
        ('cpu{job!~"web"}', {1, 3}),
        ('cpu{job=""}', {3}),
        ('cpu{absent!="x"}', {0, 1, 3}),
        ('cpu{absent=~".*"}', {0, 1, 3}),
        ('cpu{host=~"(?P<x>a)"}', {0}),
        ('cpu{host=~"a\\n?"}', {0}),
        ("missing", set()),
    ],
)
def test_matching(spark, selector, want):
    assert {r.seq for r in selected(sample_rows(spark), Query.of(selector, 0, 10)).collect()} == want


def test_parsing():
    assert s.parse_selector(" cpu ") == ("cpu", [])
    metric, found = s.parse_selector('cpu{host="a",job!="b", env=~"p.*"}')
    assert metric == "cpu" and [(m.label, m.op, m.value) for m in found] == [("host", "=", "a"), ("job", "!=", "b"), ("env", "=~", "p.*")]
    assert s.identity('m{a="1",a="2",q="x\\"y"}') == ("m", {"a": "2", "q": 'x"y'})
    for bad in ["", "9cpu", 'cpu{host="a"', "cpu{}", 'cpu{host="a" junk}', 'cpu{host=~"("}']:
        with pytest.raises(ValueError):
            s.parse_selector(bad)
    for bad in ['m{a!="x"}', 'm{__name__="x"}']:
        with pytest.raises(ValueError):
            s.identity(bad)
    with pytest.raises(ValueError):
        s.Matcher("~~", "a", "b")


def test_canonical_name_round_trip(spark):
    labels = {"z": 'say "hi"', "a": "back\\slash", "m": "plain, with {braces}"}
    name = s.series_name("cpu", labels)
    assert s.identity(name) == ("cpu", labels) and name.startswith('cpu{a="back')
    got = spark.createDataFrame([(labels,)], "l map<string,string>").select(s.series_column(F.lit("cpu"), F.col("l"))).first()[0]
    assert got == name and s.series_name("cpu") == "cpu"
    with pytest.raises(ValueError):
        s.series_name("cpu", {"1bad": "x"})


def test_expressions(spark):
    pairs = [(0, 0), (-1, 1), (1, 2), (-2, 3), (2, 4), (-64, 127), (64, 128)]
    rows = spark.createDataFrame([(x,) for x, _ in pairs], "x long").select("x", zigzag(F.col("x")).alias("z")).withColumn("back", unzigzag(F.col("z"))).collect()
    assert {(r.x, r.z) for r in rows} == set(pairs) and all(r.x == r.back for r in rows)
    bases = spark.createDataFrame([(t,) for t in (0, 7199, 7200, 21617, -5)], "t long").select(block_base(F.col("t"))).collect()
    assert [r[0] for r in bases] == [0, 0, 7200, 21600, 0]
    nan = float("nan")
    cases = [(5.0, ">", 1.0, True), (nan, ">", 1.0, False), (nan, "==", nan, False), (nan, "!=", nan, True), (1.0, "!=", nan, True), (1.0, "<=", 1.0, True), (2.0, "<", 2.0, False), (0.0, "==", -0.0, True)]
    got = spark.createDataFrame([c[:3] for c in cases], "v double, op string, t double").select(compare(F.col("v"), F.col("op"), F.col("t"))).collect()
    assert [r[0] for r in got] == [c[3] for c in cases]
