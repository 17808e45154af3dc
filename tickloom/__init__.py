"""Per-symbol time-series analytics on Spark DataFrames."""
