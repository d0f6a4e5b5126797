"""Property valuation analytics on Spark DataFrames."""
