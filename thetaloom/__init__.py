"""Psychometric and model-evaluation analytics as PySpark jobs."""
