"""evalloom: leakage-safe evaluation and data preparation on Spark DataFrames."""
