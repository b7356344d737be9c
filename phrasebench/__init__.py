"""Phrase retrieval and model-evaluation analytics as Spark jobs."""

__version__ = "0.1.0"
