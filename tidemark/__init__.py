"""Point-in-time research and market analytics as Spark DataFrame jobs."""
