"""Market ticks and time bars as Spark DataFrame functions, in batch and in Structured Streaming."""

__version__ = "0.1.0"
