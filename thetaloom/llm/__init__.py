"""Operators for cleaning and scoring training text; their queries are in :mod:`thetaloom.llm.queries`."""
