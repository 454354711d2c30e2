"""Multi-hazard event analytics as Spark DataFrame jobs."""
