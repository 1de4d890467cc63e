"""Passage retrieval and text analytics on Spark."""
