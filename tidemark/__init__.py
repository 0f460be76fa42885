"""Tidemark: incremental, point-in-time processing of feeds and calendars on Spark DataFrames."""
