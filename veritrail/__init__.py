"""Payment-evidence analytics as Spark DataFrame jobs."""
