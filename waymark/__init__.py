"""Waymark: Indian free-text address resolution as Spark DataFrame jobs."""
