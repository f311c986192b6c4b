"""Spindrift: document retrieval and corpus processing as Spark DataFrame jobs."""
