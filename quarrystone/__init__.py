"""Quarrystone: evidence analytics on Spark DataFrames, SQL and Structured Streaming."""
