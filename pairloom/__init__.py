"""Relevance-evaluation analytics on Spark."""
