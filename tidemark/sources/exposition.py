"""Text exposition lines as samples: `metric{label="value"} 12.5 [milliseconds]`.

Blank lines and comments are skipped. A line that can't be read becomes an error row and disturbs no other line. Label
values may hold blanks; with compat=True a line is split at blanks alone, so such values fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.samples import block_base
from tidemark.functions.selector import MATCHER, NAME, series_column

#: What a number looks like; fields of a line.
NUMBER = r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))"
FIELDS = r"^(\S*\{.*\}|\S+)(?:\s+(\S+))?(?:\s+(\S+))?"
PLAIN_FIELDS = r"^(\S+)(?:\s+(\S+))?(?:\s+(\S+))?"


def number(text: Column) -> Column:
    """A double, or null. Infinities and NaN have several spellings."""
    low = F.lower(F.regexp_replace(text, r"^\+", ""))
    special = F.when(low.isin("inf", "infinity"), F.lit(float("inf"))).when(low.isin("-inf", "-infinity"), F.lit(float("-inf"))).when(low.isin("nan", "-nan"), F.lit(float("nan")))
    return F.when(text.rlike(f"^{NUMBER}$"), F.coalesce(special, text.try_cast("double")))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns behind a generator of one row, so that later steps use their values and don't evaluate them again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def parsed(lines: DataFrame, default_ts: int | Column, compat: bool = False) -> DataFrame:
    """lines: rows of lineno and line. default_ts: the time of lines without one. Adds metric, labels, series, t, v and error (null where the line is good)."""
    lines = once(lines, {"text": F.regexp_replace("line", r"^\s+|\s+$", "")}).where("text <> '' AND NOT startswith(text, '#')")
    fields = PLAIN_FIELDS if compat else FIELDS
    lines = once(lines, {name: F.regexp_extract("text", fields, i) for i, name in enumerate(("name", "value", "millis"), 1)})
    braces = F.col("name").contains("{")
    body = F.when(braces & F.endswith("name", F.lit("}")), F.expr("substring(name, instr(name, '{') + 1, length(name) - instr(name, '{') - 1)")).otherwise("")
    lines = once(lines, {"metric": F.when(braces, F.expr("substring(name, 1, instr(name, '{') - 1)")).otherwise(F.col("name")), "body": body})
    every = lambda group: F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all("body", F.lit(MATCHER), F.lit(group)))
    lines = once(lines, {"keys": every(1), "operators": every(2), "raw": every(3), "rest": F.when(F.col("body") == "", "").otherwise(F.translate(F.regexp_replace("body", MATCHER, ""), ", \t", ""))})
    keys, operators = F.col("keys"), F.col("operators")
    # The last of equal labels wins: an entry goes if a later one has its key.
    plain = F.map_from_arrays(keys, F.transform("raw", lambda v: F.regexp_replace(v, r"\\(.)", "$1")))
    entries = F.transform(F.arrays_zip("keys", "raw"), lambda e, i: F.struct(e["keys"].alias("key"), e["raw"].alias("value"), (i + 1).alias("i")))
    last = F.filter(entries, lambda e: ~F.array_contains(F.slice(keys, e["i"] + 1, F.size(keys)), e["key"]))
    latest = F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], F.regexp_replace(e["value"], r"\\(.)", "$1"))))
    labels = F.when(F.size(keys) == 0, F.create_map().cast("map<string,string>")).when(F.size(F.array_distinct(keys)) == F.size(keys), plain).otherwise(latest)
    lines = once(lines, {"labels": labels, "v": number(F.col("value")), "stamp": F.when(F.col("millis").rlike(r"^[+-]?\d+$"), F.col("millis").try_cast("long"))})
    v, stamp = F.col("v"), F.col("stamp")
    bad_name = ~F.col("metric").rlike(f"^{NAME}$") | (braces & ((F.size(keys) == 0) | (F.col("rest") != "") | F.exists(operators, lambda o: o != "=") | F.array_contains(keys, "__name__")))
    at = F.concat(F.lit("line "), F.col("lineno").cast("string"), F.lit(": "))
    error = (
        F.when(F.col("value") == "", F.concat(at, F.lit("expected metric and value")))
        .when(v.isNull(), F.concat(at, F.lit("bad value '"), "value", F.lit("'")))
        .when((F.col("millis") != "") & stamp.isNull(), F.concat(at, F.lit("bad timestamp '"), "millis", F.lit("'")))
        .when(stamp <= 0, F.concat(at, F.lit("timestamp must be positive")))
        .when(bad_name, F.concat(at, F.lit("bad series '"), "name", F.lit("'")))
    )
    lines = lines.withColumn("error", error)
    lines = lines.withColumn("t", F.when(F.col("millis") == "", (default_ts if isinstance(default_ts, Column) else F.lit(default_ts)).cast("long")).otherwise(F.floor(stamp / 1000)))
    return lines.select("lineno", "metric", series_column(F.col("metric"), F.col("labels")).alias("series"), "labels", "t", "v", "error")


def good(rows: DataFrame) -> DataFrame:
    """Accepted lines as samples; the line number is the order of arrival."""
    return rows.where("error IS NULL").select("metric", "series", "labels", "t", "v", F.col("lineno").cast("long").alias("seq"), block_base(F.col("t")).alias("block_base"))


def bad(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NOT NULL").select("lineno", "error")


def lines_of(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Numbered lines of whole bodies."""
    return bodies.select("*", F.posexplode(F.split(column, r"\r\n|\n|\r"))).select(*[c for c in bodies.columns if c != column], (F.col("pos") + 1).alias("lineno"), F.col("col").alias("line"))


def rendered(samples: DataFrame) -> DataFrame:
    """Samples as exposition lines with milliseconds; the inverse of parsed."""
    return samples.select(F.concat_ws(" ", "series", F.col("v").cast("string"), (F.col("t") * 1000).cast("string")).alias("line"))
