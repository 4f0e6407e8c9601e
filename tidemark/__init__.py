"""Prospective cohort analytics as Spark DataFrame jobs."""
