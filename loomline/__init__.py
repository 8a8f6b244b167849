"""Narrative-timeline analytics as declarative Spark plans."""
