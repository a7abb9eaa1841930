"""Whole pipelines and the named queries with their SQL counterparts."""
