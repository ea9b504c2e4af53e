"""Harmony analysis of whole music corpora as Spark DataFrame jobs."""

__version__ = "0.1.0"
