"""Strategy-performance analytics for many back-test runs at once, on Spark DataFrames."""
