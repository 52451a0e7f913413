"""Cairn: web-archive analytics and record clean-up as Spark DataFrame operations."""
