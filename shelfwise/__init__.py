"""Retail stock analytics as PySpark batch jobs."""
