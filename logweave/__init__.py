"""logweave: line-oriented log exploration, ordering and export on Spark DataFrames."""
