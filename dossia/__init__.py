"""Document-audit analytics as Spark DataFrame operations."""
