"""Retail-bank customer, loan and risk analytics as Spark DataFrame jobs."""
