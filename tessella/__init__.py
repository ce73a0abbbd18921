"""tessella: analytics operators declared on the public PySpark DataFrame, SQL and Structured Streaming APIs."""

__version__ = "0.1.0"
