"""Pipelines (plan builders) and the query catalogue."""
