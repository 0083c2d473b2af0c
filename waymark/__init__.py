"""Waymark: a PySpark engine that turns crawled pages into curated site maps."""
