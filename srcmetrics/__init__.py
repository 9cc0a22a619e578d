"""Source-corpus metrics on Spark DataFrames."""
