"""Timeline evidence engine on Spark: timed-text parsing, matching, repair, scoring and audit as DataFrames."""
