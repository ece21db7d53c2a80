"""Semantic corpus analytics on PySpark."""
