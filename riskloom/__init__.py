"""Response-risk analytics as Spark DataFrame jobs."""
