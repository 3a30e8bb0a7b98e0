"""A time-series metrics engine on Spark DataFrames."""
