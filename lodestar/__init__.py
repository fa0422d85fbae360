"""Retrieval and evaluation analytics as PySpark DataFrame pipelines."""
