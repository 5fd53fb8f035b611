"""Bar and tick analytics as Spark DataFrame jobs."""
