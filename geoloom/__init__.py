"""Analytics on geometry columns, built on Spark DataFrames."""
