"""Schemas and fixed values: names, columns, limits and words that belong to the data model. `labels` never holds the metric; `seq` is the order of arrival and breaks ties of t."""

from __future__ import annotations

#: Columns of the data model.
LABELS = "map<string,string>"
SAMPLES = f"metric string, series string, labels {LABELS}, t long, v double, seq long, block_base long"
SERIES = f"series_id long, name string, metric string, labels {LABELS}"
RULES = f"id string, name string, metric string, labels {LABELS}, agg string, window_sec int, op string, threshold double, min_count int, enabled boolean, created_at long"
ALERTS = f"rule_id string, rule_name string, metric string, series string, labels {LABELS}, value double, threshold double, op string, fired_at long, message string"
FIRING = "rule_id string, series string"
BLOCKS = "series string, block_base long, part int, min_ts long, max_ts long, count int, size int, payload binary"

#: Seconds of a block, and samples that one holds at most.
BLOCK_SPAN, BLOCK_SAMPLES = 7200, 8192
#: Names of aggregates and comparators.
AGGREGATES = ("avg", "max", "min", "sum", "last", "first", "count")
RULE_AGGREGATES = ("avg", "max", "min", "sum", "last", "count")
COMPARATORS = (">", "<", ">=", "<=", "==", "!=")
#: Alerts that a report of recent ones keeps; errors that a write reports.
RECENT_ALERTS, ERRORS_SHOWN = 200, 20
