"""Queue-flow and survival analytics on Spark DataFrames."""
