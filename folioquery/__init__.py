"""Filing-analytics engine expressed as Spark DataFrame, SQL and Structured Streaming plans."""

__version__ = "0.1.0"
