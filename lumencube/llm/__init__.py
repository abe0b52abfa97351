"""Operators for preparing training text at scale, as Spark jobs."""
