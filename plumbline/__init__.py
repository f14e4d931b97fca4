"""Plumbline: evaluation analytics and corpus preparation on Spark."""
