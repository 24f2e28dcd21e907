"""Rule-based multi-label document labeling on Spark DataFrames."""
