"""Registered queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.samples import bucket, largest, smallest, unzigzag, zigzag
from tidemark.engine import Engine
from tidemark.functions.selector import labels_column, series_column
from tidemark.operators import catalog, codec, range_query, rules
from tidemark.operators.range_query import Query
from tidemark.operators.rules import AlertRule
from tidemark.sources import exposition, tables
from tidemark.sources.store import SampleTable, SeriesNumbers, scratch
from tidemark.streaming import continuous, ingest

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}

#: A range that holds all events, one month of it, and times at which rules are looked at.
FIRST, LAST = 0, 4_000_000_000
MONTH = (1_704_067_200, 1_706_745_599)
NOW, BEFORE = 1_706_659_200, 1_706_572_800
DAY = 86_400

EVENTS = """s AS (SELECT 'event_value{event_type="' || event_type || '",user="' || user_id || '"}' AS series, event_type, user_id,
  CAST(floor(epoch(ts)) AS BIGINT) AS t, value AS v, event_id AS seq FROM events)"""


def query(sql: str | None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def register_aggregate(agg: str, sql: str) -> None:
    digits = agg in ("avg", "sum")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = range_query.range_query(tables.events(spark, sf_dir), Query("event_value", FIRST, LAST, step=3600, agg=agg), seq_follows_time=True)
        return out.withColumn("v", F.round("v", 4)) if digits else out

    run.__name__ = f"ds_{agg}"
    value = f"round({sql}, 4)" if digits else sql
    query(f"WITH {EVENTS} SELECT series, t - t % 3600 AS t, {value} AS v FROM s GROUP BY series, t - t % 3600")(run)


for _agg, _sql in {"avg": "avg(v)", "max": "max(v)", "min": "min(v)", "sum": "sum(v)", "first": "arg_min(v, seq)", "last": "arg_max(v, seq)", "count": "CAST(count(*) AS DOUBLE)"}.items():
    register_aggregate(_agg, _sql)


@query(f"WITH {EVENTS} SELECT series, t, v, seq FROM s WHERE t BETWEEN {MONTH[0]} AND {MONTH[1]}")
def range_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_query.range_query(tables.events(spark, sf_dir, *MONTH), Query("event_value", *MONTH))


@query(f"WITH {EVENTS} SELECT series, t, v, seq FROM s")
def ds_step1_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_query.range_query(tables.events(spark, sf_dir), Query("event_value", FIRST, LAST, step=1, agg="count"))


@query(f"WITH {EVENTS}, b AS (SELECT quantile_disc(t, 0.25) AS a, quantile_disc(t, 0.75) AS z FROM s) SELECT series, t, v, seq FROM s, b WHERE t > a AND t < z OR t = a OR t = z")
def range_inclusive_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range whose ends lie on samples inside the table: both are in."""
    samples = tables.events(spark, sf_dir)
    first, last = samples.agg(F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY t)").cast("long"), F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY t)").cast("long")).first()
    return range_query.range_query(samples, Query("event_value", first, last))


@query(f"WITH {EVENTS} SELECT event_type, t - t % {DAY} AS t, round(sum(v), 4) AS v FROM s GROUP BY 1, 2")
def ds_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = range_query.range_query(tables.events(spark, sf_dir), Query("event_value", FIRST, LAST, step=DAY, agg="sum", by=["event_type"]))
    return out.withColumn("v", F.round("v", 4))


def matched(spark: SparkSession, sf_dir: str, selector: str) -> DataFrame:
    rows = range_query.selected(tables.events(spark, sf_dir), Query.of(selector, FIRST, LAST))
    return rows.groupBy("series").agg(F.count("*").alias("n"))


def register_match(name: str, selector: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matched(spark, sf_dir, selector)

    run.__name__ = name
    query(f"WITH {EVENTS} SELECT series, count(*) AS n FROM s WHERE {where} GROUP BY series")(run)


register_match("match_eq", 'event_value{event_type="click"}', "event_type = 'click'")
register_match("match_regex_full", 'event_value{event_type=~"c.*|v.*"}', "regexp_full_match(event_type, 'c.*|v.*')")
register_match("match_nregex", 'event_value{event_type!~"c.*", user=~"1.*"}', "NOT regexp_full_match(event_type, 'c.*') AND regexp_full_match(CAST(user_id AS VARCHAR), '1.*')")
register_match("match_multi", 'event_value{event_type!="view", user=~"[0-9]*[02468]", absent=""}', "event_type <> 'view' AND user_id % 2 = 0")


@query("""WITH s AS (SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN user_id % 2 = 0 THEN 'web' ELSE 'app' END END AS platform FROM events)
SELECT event_type, coalesce(platform, '') AS platform, count(*) AS n FROM s WHERE coalesce(platform, '') <> 'web' GROUP BY ALL""")
def match_neq_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    platform = F.when(F.col("labels")["event_type"].isin("click", "view"), F.when(F.col("seq_user") % 2 == 0, "web").otherwise("app"))
    samples = tables.events(spark, sf_dir).withColumn("seq_user", F.col("labels")["user"].cast("long")).withColumn("platform", platform)
    labels = F.when(F.col("platform").isNull(), F.col("labels")).otherwise(F.map_concat("labels", F.create_map(F.lit("platform"), "platform")))
    rows = range_query.selected(samples.withColumn("labels", labels), Query.of('event_value{platform!="web"}', FIRST, LAST))
    return rows.groupBy(F.col("labels")["event_type"].alias("event_type"), F.coalesce(F.try_element_at("labels", F.lit("platform")), F.lit("")).alias("platform")).agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS}, n AS (SELECT DISTINCT series FROM s) SELECT row_number() OVER (ORDER BY series) AS series_id, series AS name, 'event_value' AS metric FROM n")
def series_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_ids(catalog.series(tables.events(spark, sf_dir))).select("series_id", "name", "metric")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT event_type, user_id FROM events)) AS series, CAST(3 AS BIGINT) AS label_keys, (SELECT count(DISTINCT event_type) + count(DISTINCT user_id) + 1 FROM events) AS label_pairs")
def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.label_stats(catalog.series(tables.events(spark, sf_dir)))


@query(f"WITH {EVENTS} SELECT series, max(t) AS t, arg_max(v, seq) AS v FROM s WHERE t BETWEEN {NOW - 7 * DAY} AND {NOW + 1} GROUP BY series")
def latest_per_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_query.latest(tables.events(spark, sf_dir, NOW - 7 * DAY, NOW + 1), "event_value", NOW, 7 * DAY, seq_follows_time=True)


@query(f"WITH {EVENTS} SELECT series, count(*) AS n, min(t) AS first_t, max(t) AS last_t, arg_min(v, seq) AS first_v FROM s GROUP BY series")
def nested_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = range_query.nested(range_query.range_query(tables.events(spark, sf_dir), Query("event_value", FIRST, LAST)))
    return points.select("series", F.size("points").cast("long").alias("n"), F.col("points")[0]["t"].alias("first_t"), F.element_at("points", -1)["t"].alias("last_t"), F.col("points")[0]["v"].alias("first_v"))


def rule(**spec) -> AlertRule:
    return AlertRule(**{"id": "r1", "name": "high", "metric": "event_value", "window_sec": DAY, "threshold": 60.0} | spec)


def rule_sql(now: int, agg: str = "avg(v)") -> str:
    """Value and samples of each series: the aggregate over its last bucket, and the count of the whole range."""
    return f"""r{now} AS (SELECT * FROM s WHERE t BETWEEN {now - DAY} AND {now + 1}),
b{now} AS (SELECT series, t - t % {DAY} AS bk, {agg} AS v, count(*) AS n FROM r{now} GROUP BY ALL),
x{now} AS (SELECT series, arg_max(v, bk) AS value, CAST(sum(n) AS BIGINT) AS samples FROM b{now} GROUP BY series)"""


@query(f"WITH {EVENTS}, {rule_sql(NOW)} SELECT 'r1' AS rule_id, series, round(value, 4) AS value, samples FROM x{NOW}")
def rule_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.events(spark, sf_dir, NOW - DAY, NOW + 1)
    got = rules.rule_values(samples, rules.rules_frame(spark, [rule()]), NOW, seq_follows_time=True)
    return got.select("rule_id", "series", F.round("value", 4).alias("value"), "samples")


def fired(spark: SparkSession, sf_dir: str, some: list[AlertRule]) -> DataFrame:
    alerts, _, _ = rules.evaluate(tables.events(spark, sf_dir, NOW - DAY, NOW + 1), rules.rules_frame(spark, some), rules.empty_firing(spark), NOW, seq_follows_time=True)
    return alerts.select("rule_id", "series", F.round("value", 4).alias("value"), "op", "fired_at")


def register_rule(name: str, op: str, sql_op: str, threshold: float = 60.0, min_count: int = 1, agg: str = "avg", sql_agg: str = "avg(v)") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fired(spark, sf_dir, [rule(op=op, threshold=threshold, min_count=min_count, agg=agg)])

    run.__name__ = name
    query(f"WITH {EVENTS}, {rule_sql(NOW, sql_agg)} SELECT 'r1' AS rule_id, series, round(value, 4) AS value, '{op}' AS op, CAST({NOW} AS BIGINT) AS fired_at FROM x{NOW} WHERE value {sql_op} {threshold} AND samples >= {min_count}")(run)


register_rule("rule_fire_gt", ">", ">")
register_rule("rule_fire_lt", "<", "<")
register_rule("rule_fire_ge", ">=", ">=", 2.0, agg="count", sql_agg="count(*)::DOUBLE")
register_rule("rule_fire_le", "<=", "<=", 1.0, agg="count", sql_agg="count(*)::DOUBLE")
register_rule("rule_fire_eq", "==", "=", 1.0, agg="count", sql_agg="count(*)::DOUBLE")
register_rule("rule_fire_ne", "!=", "<>", 1.0, agg="count", sql_agg="count(*)::DOUBLE")
register_rule("rule_min_count", ">", ">", 10.0, min_count=2, agg="max", sql_agg="max(v)")


def two_ticks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    samples, frame = tables.events(spark, sf_dir, BEFORE - DAY, NOW + 1), rules.rules_frame(spark, [rule()])
    _, firing, _ = rules.evaluate(samples, frame, rules.empty_firing(spark), BEFORE, seq_follows_time=True)
    return rules.evaluate(samples, frame, firing, NOW, seq_follows_time=True)


TICKS = f"WITH {EVENTS}, {rule_sql(BEFORE)}, {rule_sql(NOW)}, a AS (SELECT series FROM x{BEFORE} WHERE value > 60), z AS (SELECT series, value FROM x{NOW} WHERE value > 60)"


@query(f"{TICKS} SELECT 'r1' AS rule_id, series, round(value, 4) AS value FROM z WHERE series NOT IN (SELECT series FROM a)")
def rule_edge_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_ticks(spark, sf_dir)[0].select("rule_id", "series", F.round("value", 4).alias("value"))


@query(f"{TICKS} SELECT 'r1' AS rule_id, series FROM a WHERE series NOT IN (SELECT series FROM z)")
def rule_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_ticks(spark, sf_dir)[2]


DAILY = f"""WITH b AS (SELECT event_type, CAST(floor(epoch(ts) / {DAY}) AS BIGINT) AS day, max(value) > 150 AS active FROM events GROUP BY ALL),
c AS (SELECT *, lag(active) OVER w AS prev, lag(day) OVER w AS prev_day FROM b WINDOW w AS (PARTITION BY event_type ORDER BY day)),
e AS (SELECT event_type, day FROM c WHERE active AND NOT (coalesce(prev, false) AND prev_day = day - 1))"""


def daily_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = tables.events(spark, sf_dir).groupBy(F.col("labels")["event_type"].alias("event_type"), F.floor(F.col("t") / DAY).alias("day")).agg((largest(F.col("v")) > 150).alias("active"))
    return rules.replay_edges(daily, ["event_type"], "day").select("event_type", "day")


@query(f"{DAILY} SELECT event_type, day FROM e")
def rule_edge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_edges(spark, sf_dir)


@query(f"{DAILY} SELECT 'r1' AS rule_id, event_type AS series, day * {DAY} AS fired_at FROM e ORDER BY fired_at DESC, rule_id, series LIMIT 200")
def alerts_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.recent(daily_edges(spark, sf_dir).select(F.lit("r1").alias("rule_id"), F.col("event_type").alias("series"), (F.col("day") * DAY).alias("fired_at")))


@query(f"WITH {EVENTS}, {rule_sql(NOW, 'max(v)')} SELECT series, 'high: max(event_value) over {DAY}s is ' || printf('%.4g', value) || ', expected > 60' AS message FROM x{NOW} WHERE value > 60")
def alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, _, _ = rules.evaluate(tables.events(spark, sf_dir, NOW - DAY, NOW + 1), rules.rules_frame(spark, [rule(agg="max")]), rules.empty_firing(spark), NOW, seq_follows_time=True)
    return alerts.select("series", "message")


@query(f"WITH {EVENTS} SELECT series, t, v FROM s")
def exposition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = exposition.rendered(tables.events(spark, sf_dir)).withColumn("lineno", F.lit(1))
    return exposition.good(exposition.parsed(lines, 0)).select("series", "t", "v")


@query("""SELECT CASE event_id % 6 WHEN 0 THEN 'line ' || event_id || ': expected metric and value' WHEN 1 THEN 'line ' || event_id || ': bad value ''x' || user_id || ''''
  WHEN 2 THEN 'line ' || event_id || ': bad timestamp ''soon''' WHEN 3 THEN 'line ' || event_id || ': timestamp must be positive' END AS error, event_id AS lineno
FROM events WHERE event_id % 6 < 4""")
def exposition_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 6
    user = F.col("user_id").cast("string")
    line = F.when(kind == 0, F.lit("novalue")).when(kind == 1, F.concat(F.lit("m x"), user)).when(kind == 2, F.lit("m 1 soon")).when(kind == 3, F.lit("m 2.5e3 -5")).when(kind == 4, F.lit("# comment")).otherwise(F.concat(F.lit('m{user="'), user, F.lit('"} +Inf')))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("lineno"), line.alias("line"))
    return exposition.bad(exposition.parsed(rows, 7)).select("error", "lineno")


@query("""WITH s AS (SELECT event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
hw AS (SELECT event_type, max(t) AS hw FROM s WHERE event_id % 3 = 0 AND t < 1705276800 AND event_type <> 'view' GROUP BY ALL)
SELECT s.event_type AS series, count(*) AS n FROM s LEFT JOIN hw USING (event_type) WHERE hw.hw IS NULL OR s.t > hw.hw GROUP BY ALL""")
def high_water_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.events(spark, sf_dir).withColumn("series", F.col("labels")["event_type"])
    sealed = samples.where((F.col("seq") % 3 == 0) & (F.col("t") < 1705276800) & (F.col("series") != "view"))
    return catalog.high_water(samples, sealed).groupBy("series").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT series, t - t % 7200 AS block_base, min(t) AS min_ts, max(t) AS max_ts, count(*) AS n FROM s GROUP BY ALL")
def block_zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.zone_map(tables.events(spark, sf_dir))


@query(f"WITH {EVENTS}, z AS (SELECT series, t - t % 7200 AS block_base, min(t) AS min_ts, max(t) AS max_ts, count(*) AS n FROM s GROUP BY ALL) SELECT * FROM z WHERE max_ts >= {MONTH[0]} AND min_ts <= {MONTH[1]}")
def block_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.overlapping(catalog.zone_map(tables.events(spark, sf_dir)), *MONTH)


@query("""WITH s AS (SELECT o_orderstatus, o_orderkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t FROM orders),
p AS (SELECT o_orderstatus AS series, t - t % 7200 AS block_base, CAST(floor((row_number() OVER (PARTITION BY o_orderstatus, t - t % 7200 ORDER BY t, o_orderkey) - 1) / 2) AS INTEGER) AS part FROM s)
SELECT series, block_base, part, count(*) AS n FROM p GROUP BY ALL""")
def block_cap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.orders(spark, sf_dir).withColumn("series", F.col("labels")["status"])
    return catalog.split_blocks(samples, 2).groupBy("series", "block_base", "part").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
d AS (SELECT *, t - lag(t) OVER w AS delta FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
e AS (SELECT *, delta - coalesce(lag(delta) OVER w, 0) AS dod FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
z AS (SELECT user_id, dod, CASE WHEN dod >= 0 THEN 2 * dod ELSE -2 * dod - 1 END AS zz FROM e)
SELECT CAST(user_id AS VARCHAR) AS user, CAST(sum(CASE WHEN dod IS NULL THEN 64 WHEN dod = 0 THEN 1 WHEN zz <= 255 THEN 11
  WHEN zz <= 4095 THEN 15 WHEN zz <= 4294967295 THEN 36 ELSE 68 END) AS BIGINT) AS ts_bits FROM z GROUP BY user_id""")
def dod_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.events(spark, sf_dir).withColumn("user", F.col("labels")["user"])
    return codec.timestamp_bits(samples, ["user"])


@query("""SELECT event_id AS x, CASE WHEN event_id % 2 = 0 THEN event_id ELSE -event_id END AS signed, CASE WHEN event_id % 2 = 0 THEN 2 * event_id ELSE 2 * event_id - 1 END AS z,
CASE WHEN event_id % 2 = 0 THEN event_id ELSE -event_id END AS back FROM events""")
def zigzag_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(-F.col("event_id"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("x"), signed.alias("signed"))
    return rows.withColumn("z", zigzag(F.col("signed"))).withColumn("back", unzigzag(F.col("z")))


@query(f"""WITH {EVENTS}, z AS (SELECT series, t - t % 7200 AS b, count(*) AS n FROM s GROUP BY ALL)
SELECT (SELECT count(DISTINCT series) FROM s) AS series, (SELECT count(*) FROM z) AS sealed_blocks, (SELECT count(*) FROM s) AS total_samples,
(SELECT min(t) FROM s) AS min_ts, (SELECT max(t) FROM s) AS max_ts, (SELECT min(v) FROM s) AS min_v, (SELECT max(v) FROM s) AS max_v""")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.ingest_stats(tables.events(spark, sf_dir))


@query("""WITH s AS (SELECT user_id, CASE WHEN user_id % 10 = 0 OR event_id % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS v FROM events)
SELECT CAST(user_id AS VARCHAR) AS user, coalesce(max(v) FILTER (WHERE NOT isnan(v)), CAST('-inf' AS DOUBLE)) AS mx,
coalesce(min(v) FILTER (WHERE NOT isnan(v)), CAST('inf' AS DOUBLE)) AS mn FROM s GROUP BY user_id""")
def nan_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("labels")["user"]
    v = F.when((user.cast("long") % 10 == 0) | (F.col("seq") % 7 == 0), F.lit(float("nan"))).otherwise(F.col("v"))
    return tables.events(spark, sf_dir).groupBy(user.alias("user")).agg(largest(v).alias("mx"), smallest(v).alias("mn"))


@query("SELECT 'order_total{priority=\"' || o_orderpriority || '\",status=\"' || o_orderstatus || '\"}' AS series, CAST(floor(epoch(o_orderdate)) AS BIGINT) - CAST(floor(epoch(o_orderdate)) AS BIGINT) % 86400 AS t, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL")
def orders_daily_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = range_query.range_query(tables.orders(spark, sf_dir), Query("order_total", FIRST, LAST, step=DAY, agg="sum"))
    return out.withColumn("v", F.round("v", 2))


@query("SELECT 'line_price{linestatus=\"' || l_linestatus || '\",returnflag=\"' || l_returnflag || '\"}' AS series, CAST(floor(epoch(l_shipdate)) AS BIGINT) - CAST(floor(epoch(l_shipdate)) AS BIGINT) % 604800 AS t, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY ALL")
def lineitem_sum_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = range_query.range_query(tables.lineitem(spark, sf_dir), Query("line_price", FIRST, LAST, step=7 * DAY, agg="sum"))
    return out.withColumn("v", F.round("v", 2))


@query(f"WITH {EVENTS} SELECT series, t, v FROM s")
def gorilla_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.samples_of(codec.blocks(tables.events(spark, sf_dir))).select("series", "t", "v")


@query(None)
def gorilla_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sizes of the coder's output; SQL has no bit coder, so the round trip above and tests check it."""
    day = tables.events(spark, sf_dir).withColumn("series", F.col("labels")["event_type"]).withColumn("block_base", bucket(F.col("t"), 30 * DAY))
    return codec.report(codec.blocks(day))


@query("SELECT event_type || '\"\\' AS raw, 'm{a=\"1\",q=\"' || event_type || '\\\"\\\\\"}' AS name, count(*) AS n FROM events GROUP BY event_type")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("event_type", F.lit('"\\'))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(raw.alias("raw"))
    name = series_column(F.lit("m"), F.create_map(F.lit("q"), F.col("raw"), F.lit("a"), F.lit("1")))
    return rows.withColumn("name", name).groupBy("raw", "name").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS}, w AS (SELECT *, t - lag(t) OVER (PARTITION BY series ORDER BY t, seq) AS gap FROM s) SELECT series, CAST(sum(CASE WHEN gap IS NULL OR gap > {DAY} THEN 1 ELSE 0 END) AS BIGINT) AS sessions FROM w GROUP BY series")
def series_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of samples without a day's silence, for each series."""
    w = Window.partitionBy("series").orderBy("t", "seq")
    gaps = tables.events(spark, sf_dir).withColumn("gap", F.col("t") - F.lag("t").over(w))
    return gaps.groupBy("series").agg(F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > DAY), 1).otherwise(0)).cast("long").alias("sessions"))


# Labels, numbers and order of results.


@query(f"WITH {EVENTS} SELECT series, t, v, event_type, CAST(user_id AS VARCHAR) AS user, 'event_value' AS metric FROM s WHERE t BETWEEN {MONTH[0]} AND {MONTH[1]}")
def range_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = range_query.with_labels(range_query.range_query(tables.events(spark, sf_dir, *MONTH), Query("event_value", *MONTH)))
    return rows.select("series", "t", "v", F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user"].alias("user"), F.col("labels")["__name__"].alias("metric"))


@query(f"WITH {EVENTS} SELECT series, event_type, CAST(user_id AS VARCHAR) AS user, count(*) AS n, CAST(sum(t) AS BIGINT) AS times FROM s GROUP BY ALL")
def nested_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = range_query.nested(range_query.range_query(tables.events(spark, sf_dir), Query("event_value", FIRST, LAST)))
    times = F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a + p["t"])
    return rows.select("series", F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user"].alias("user"), F.size("points").cast("long").alias("n"), times.alias("times"))


@query(f"WITH {EVENTS} SELECT series, t - t % 7200 AS block_base, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM s GROUP BY ALL")
def nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = range_query.nested_blocks(range_query.range_query(tables.events(spark, sf_dir), Query("event_value", FIRST, LAST)))
    return rows.select("series", "block_base", F.size("points").cast("long").alias("n"), F.col("points")[0]["t"].alias("first_t"), F.element_at("points", -1)["t"].alias("last_t"))


@query(f"WITH {EVENTS} SELECT series, t, v FROM s")
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of every series, read back."""
    rows = range_query.as_json(range_query.range_query(tables.events(spark, sf_dir), Query("event_value", FIRST, LAST)))
    back = F.from_json("json", "name string, labels map<string,string>, points array<struct<t: long, v: double>>")
    return rows.select(back.alias("j")).select(F.col("j.name").alias("series"), F.explode("j.points").alias("p")).select("series", "p.t", "p.v")


@query(f"WITH {EVENTS}, n AS (SELECT series, row_number() OVER (ORDER BY series) AS series_id FROM (SELECT DISTINCT series FROM s)) SELECT series_id, s.series, t, v FROM s JOIN n USING (series) WHERE t BETWEEN {MONTH[0]} AND {MONTH[1]} ORDER BY series_id, t, seq")
def result_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = catalog.with_ids(catalog.series(tables.events(spark, sf_dir)))
    rows = range_query.range_query(tables.events(spark, sf_dir, *MONTH), Query("event_value", *MONTH))
    return range_query.ordered(rows, ids).select("series_id", "series", "t", "v")


@query(f"WITH {EVENTS} SELECT series, t, v, seq FROM s ORDER BY series, t, seq LIMIT 100")
def range_ordered_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows of an ordered answer: the limit is the feature."""
    return range_query.ordered(range_query.range_query(tables.events(spark, sf_dir), Query("event_value", FIRST, LAST))).limit(100)


@query(f"WITH {EVENTS}, n AS (SELECT series, row_number() OVER (ORDER BY series) AS series_id FROM (SELECT DISTINCT series FROM s)) SELECT DISTINCT series_id, series AS name, event_type, CAST(user_id AS VARCHAR) AS user FROM s JOIN n USING (series) WHERE series_id = 7")
def series_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.by_id(catalog.with_ids(catalog.series(tables.events(spark, sf_dir))), 7)
    return rows.select("series_id", "name", F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user"].alias("user"))


@query(f"WITH {EVENTS}, n AS (SELECT series, row_number() OVER (ORDER BY series) AS series_id FROM (SELECT DISTINCT series FROM s)) SELECT DISTINCT series_id, series AS name FROM s JOIN n USING (series) WHERE event_type = 'click' AND user_id = (SELECT max(user_id) FROM events WHERE event_type = 'click')")
def series_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.events(spark, sf_dir)
    user = samples.where(F.col("labels")["event_type"] == "click").agg(F.max(F.col("labels")["user"].cast("long"))).first()[0]
    return catalog.by_name(catalog.with_ids(catalog.series(samples)), "event_value", {"user": str(user), "event_type": "click"}).select("series_id", "name")


@query(f"WITH {EVENTS} SELECT DISTINCT series, 'event_value' AS metric, event_type, CAST(user_id AS VARCHAR) AS user, CAST(3 AS INTEGER) AS n FROM s")
def identity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.series(tables.events(spark, sf_dir)).select(F.col("name").alias("series"), labels_column(F.col("name")).alias("l"))
    return rows.select("series", F.col("l")["__name__"].alias("metric"), F.col("l")["event_type"].alias("event_type"), F.col("l")["user"].alias("user"), F.size("l").alias("n"))


@query(f"WITH {EVENTS} SELECT series, count(*) AS n FROM s WHERE event_type = 'click' AND user_id = 1 GROUP BY series UNION ALL SELECT series, count(*) FROM s WHERE event_type = 'view' GROUP BY series")
def match_label_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = (Query("event_value", FIRST, LAST, {"event_type": "click", "user": "1"}), Query("event_value", FIRST, LAST, {"event_type": "view", "absent": ""}))
    one, other = (range_query.selected(tables.events(spark, sf_dir), q).groupBy("series").agg(F.count("*").alias("n")) for q in queries)
    return one.unionByName(other)


# The stored table: writes, scans, upkeep, listeners, numbers.


def filled(spark: SparkSession, sf_dir: str, name: str) -> SampleTable:
    """The events as a stored table, in two batches: those of odd numbers come late, with old times."""
    table, samples = SampleTable(spark, scratch(spark, name)), tables.events(spark, sf_dir)
    table.append(samples.where("seq % 2 = 0"))
    table.append(samples.where("seq % 2 = 1"))
    return table


@query(f"WITH {EVENTS} SELECT series, t - t % 7200 AS block_base, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs, round(sum(v), 4) AS v FROM s GROUP BY ALL")
def stored_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filled(spark, sf_dir, "stored").read()
    return rows.groupBy("series", "block_base").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"), F.round(F.sum("v"), 4).alias("v"))


@query(f"WITH {EVENTS} SELECT series, t - t % 3600 AS t, arg_max(v, seq) AS v FROM s WHERE t BETWEEN {MONTH[0]} AND {MONTH[1]} GROUP BY ALL")
def stored_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range query over stored blocks, which prunes them; late samples are there."""
    return range_query.range_query(filled(spark, sf_dir, "stored").read(), Query("event_value", *MONTH, step=3600, agg="last"))


@query(f"WITH {EVENTS} SELECT series, t, v, seq FROM s")
def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = filled(spark, sf_dir, "compacted")
    largest_block = table.read().groupBy("block_base").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "block_base").first()
    table.compact(largest_block.block_base)
    return table.read().select("series", "t", "v", "seq")


@query("SELECT 'nation{region=\"' || n_regionkey || '\"}' AS series, CAST(n_nationkey AS BIGINT) AS t, CAST(n_nationkey * 2 AS DOUBLE) AS v FROM nation")
def single_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One write for each region's series, by name."""
    table = SampleTable(spark, scratch(spark, "single"))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("k"))
    for r in rows.collect():  # a row for each region
        table.write(f'nation{{region="{r.n_regionkey}"}}', list(r.k), [2.0 * k for k in r.k])
    return table.read().select("series", "t", "v")


@query("SELECT event_id % 2 AS batch, count(*) AS n, count(DISTINCT (event_type, user_id)) AS series FROM events GROUP BY event_id % 2")
def notified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a subscriber to the table sees: each batch once, after it is stored."""
    table, samples, seen = SampleTable(spark, scratch(spark, "notified")), tables.events(spark, sf_dir), []
    table.subscribe(lambda batch: seen.append(batch.agg(F.min(F.col("seq") % 2).alias("batch"), F.count("*").alias("n"), F.countDistinct("series").alias("series"))))
    for k in (0, 1):
        table.append(samples.where(F.col("seq") % 2 == k))
    return seen[0].unionByName(seen[1])


@query(f"""WITH {EVENTS}, a AS (SELECT series, row_number() OVER (ORDER BY series) AS series_id FROM (SELECT DISTINCT series FROM s WHERE event_type = 'view')),
b AS (SELECT series, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY series) AS series_id FROM (SELECT DISTINCT series FROM s WHERE event_type <> 'view'))
SELECT series_id, series AS name FROM a UNION ALL SELECT series_id, series FROM b""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers stay when series arrive that come before others by name."""
    table, samples = SampleTable(spark, scratch(spark, "numbers")), tables.events(spark, sf_dir)
    table.append(samples.where(F.col("labels")["event_type"] == "view"))
    SeriesNumbers(table).current()
    table.append(samples.where(F.col("labels")["event_type"] != "view"))
    return SeriesNumbers(table).current().select("series_id", "name")


@query("SELECT count(*) FILTER (n_nationkey % 5 <> 0) AS accepted, count(*) FILTER (n_nationkey % 5 = 0) AS skipped, count(DISTINCT n_regionkey) FILTER (n_nationkey % 5 <> 0) AS series, min(n_nationkey + 1) FILTER (n_nationkey % 5 = 0) AS first_error FROM nation")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on one body, of a line for each nation: good and bad lines, series, first error."""
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select("n_nationkey", "n_regionkey").collect()
    body = "\n".join(f'nation{{region="{n.n_regionkey}"}} {n.n_nationkey if n.n_nationkey % 5 else "none"}' for n in names)
    report = Engine(spark, scratch(spark, "report")).ingest(body, 60)
    first = int(report["errors"][0].split()[1].rstrip(":"))
    return spark.createDataFrame([(report["accepted"], report["skipped"], report["series"], first)], "accepted long, skipped long, series long, first_error long")


@query(f"WITH {EVENTS} SELECT series, t, v FROM s")
def default_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without a time take the one that their batch gives."""
    rows = tables.events(spark, sf_dir).select(F.concat_ws(" ", "series", F.col("v").cast("string")).alias("line"), F.lit(1).alias("lineno"), F.col("t").alias("arrived"))
    return exposition.good(exposition.parsed(rows, F.col("arrived"))).select("series", "t", "v")


@query("SELECT 'line ' || event_id || ': bad value ' || chr(39) || 'x' || chr(39) AS error, event_id AS lineno FROM events WHERE event_id % 3 = 0 ORDER BY event_id LIMIT 20")
def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty errors of a report: the limit is the feature."""
    line = F.when(F.col("event_id") % 3 == 0, F.lit("m x")).otherwise(F.lit("m 1"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("lineno"), line.alias("line"))
    return exposition.bad(exposition.parsed(rows, 7)).orderBy("lineno").limit(20).select("error", "lineno")


# Rules: which take part, and what they leave.


@query(f"WITH {EVENTS}, {rule_sql(NOW)} SELECT 'r1' AS rule_id, series, round(value, 4) AS value, '>' AS op, CAST({NOW} AS BIGINT) AS fired_at FROM x{NOW} WHERE value > 60")
def rule_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fired(spark, sf_dir, [rule(), rule(id="r2", enabled=False)])


@query(f"WITH {EVENTS}, {rule_sql(NOW)} SELECT 'r1' AS rule_id, series, round(value, 4) AS value, '>' AS op, CAST({NOW} AS BIGINT) AS fired_at FROM x{NOW} WHERE value > 60")
def rule_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that can't be evaluated are set aside, and the others fire."""
    bad = [rule(id=f"r{k}") for k in (2, 3, 4)]
    bad[0].agg, bad[1].window_sec, bad[2].threshold = "median", 0, "high"
    return fired(spark, sf_dir, [*bad, rule()])


@query(f"WITH {EVENTS}, {rule_sql(NOW)} SELECT 'r1' AS rule_id, series, CAST({NOW} AS BIGINT) AS fired_at, 'high' AS name FROM x{NOW} WHERE value > 60")
def alert_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, _, _ = rules.evaluate(tables.events(spark, sf_dir, NOW - DAY, NOW + 1), rules.rules_frame(spark, [rule()]), rules.empty_firing(spark), NOW, seq_follows_time=True)
    get = lambda c: F.get_json_object("json", f"$.{c}")
    return rules.as_json(alerts).select(get("ruleId").alias("rule_id"), get("series").alias("series"), get("firedAt").cast("long").alias("fired_at"), get("ruleName").alias("name"))


@query(f"""WITH {EVENTS}, {rule_sql(NOW)} SELECT rule_id, series FROM (SELECT 'r' || k AS rule_id, series, value, samples, k FROM x{NOW}, (VALUES (1), (2)) AS r(k))
WHERE k = 1 AND value > 60 OR k = 2 AND value > 20 AND series LIKE '%event_type="click"%'""")
def rules_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rules, with labels of their own, in one evaluation; ids are given in order."""
    some = rules.RuleSet()
    spec = {"name": "high", "metric": "event_value", "window_sec": DAY}
    some.add(**spec, threshold=60.0)
    some.add(**spec, threshold=20.0, labels={"event_type": "click"})
    alerts, _, _ = rules.evaluate(tables.events(spark, sf_dir, NOW - DAY, NOW + 1), some.frame(spark), rules.empty_firing(spark), NOW, seq_follows_time=True)
    return alerts.select("rule_id", "series")


# Streams.


@query(f"WITH {EVENTS} SELECT series, t - t % 3600 AS t, count(*) AS n, max(v) AS high, min(v) AS low, round(sum(v), 4) AS total FROM s GROUP BY series, t - t % 3600")
def rollup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The continuous rollup over all events as a stream: the last state of each bucket equals the batch's."""
    source, out = scratch(spark, "stream"), scratch(spark, "rollup")
    tables.events(spark, sf_dir).write.parquet(source)
    stream = continuous.rollup(continuous.sample_stream(spark, source), 3600)
    store = lambda df, n: df.withColumn("n_batch", F.lit(n)).write.mode("append").parquet(out)
    stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    last = rows.groupBy("series", "t").agg(*(F.max_by(c, "n_batch").alias(c) for c in ("count", "max", "min", "sum")))
    return last.select("series", "t", F.col("count").alias("n"), F.col("max").alias("high"), F.col("min").alias("low"), F.round("sum", 4).alias("total"))


@query(f"WITH {EVENTS} SELECT series, t, v FROM s")
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposition files that land one after another, the newest first: all samples are stored once, over a restart too."""
    landing, table, checkpoint = (scratch(spark, k) for k in ("landing", "table", "checkpoint"))
    lines = exposition.rendered(tables.events(spark, sf_dir).where("seq % 2 = 1")), exposition.rendered(tables.events(spark, sf_dir).where("seq % 2 = 0"))
    for k, part in enumerate(lines):
        part.write.mode("append").text(landing)
        ingest.start(spark, landing, table, checkpoint, once=True).awaitTermination()
    ingest.start(spark, landing, table, checkpoint, once=True).awaitTermination()
    return ingest.stored(spark, table).select("series", "t", "v")


@query(f"{TICKS} SELECT 'r1' AS rule_id, series, CAST({BEFORE} AS BIGINT) AS fired_at FROM a UNION ALL SELECT 'r1', series, CAST({NOW} AS BIGINT) FROM z WHERE series NOT IN (SELECT series FROM a)")
def watch_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two evaluations of a stream of ticks with a restart between them: what fired before doesn't fire again."""
    ticks, state, checkpoint, out = (scratch(spark, k) for k in ("ticks", "firing", "checkpoint", "alerts"))
    samples = tables.events(spark, sf_dir, BEFORE - DAY, NOW + 1)
    for now in (BEFORE, NOW):
        spark.createDataFrame([(str(now),)], "value string").write.mode("append").text(ticks)
        firing = continuous.Firing(spark, state)  # nothing is remembered but the folder
        store = lambda alerts, n: alerts.write.mode("append").parquet(out)
        continuous.watch(spark.readStream.text(ticks), lambda: samples, lambda: rules.rules_frame(spark, [rule()]), firing, lambda n, now=now: now, store, checkpoint, once=True).awaitTermination()
    return spark.read.parquet(out).select("rule_id", "series", "fired_at")
