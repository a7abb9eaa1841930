"""varweave: a PySpark engine for merging, annotating and curating structural-variant tables."""

__version__ = "0.1.0"
