"""Retail customer analytics written as Spark DataFrame jobs."""
