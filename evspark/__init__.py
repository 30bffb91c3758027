"""Event-trigger analytics on Spark DataFrames and Structured Streaming."""
