"""Retrieval and knowledge-graph analytics as Spark DataFrame jobs."""
