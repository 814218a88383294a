"""Track telemetry and race history analytics, expressed as Spark DataFrame jobs."""
