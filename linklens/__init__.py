"""linklens: link-traffic analytics as Spark DataFrame and Structured Streaming jobs."""

__all__ = ["session"]
