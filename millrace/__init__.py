"""millrace: a Spark-first analytics engine for wide event tables."""

__version__ = "0.1.0"
