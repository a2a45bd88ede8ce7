"""Shop traffic and trade analytics as Spark DataFrame operators (batch and Structured Streaming)."""

__version__ = "0.1.0"
