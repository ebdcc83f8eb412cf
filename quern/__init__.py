"""Retrieval and evaluation analytics on Spark."""
