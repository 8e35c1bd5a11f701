"""Property-transaction analytics expressed as Spark DataFrame jobs."""
