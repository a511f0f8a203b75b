"""Spark operators that turn read-out document text into checked, structured records."""

__version__ = "0.1.0"
