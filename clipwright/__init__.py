"""Highlight-event analytics as Spark DataFrame, SQL and streaming jobs."""
