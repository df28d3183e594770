"""Catalogue search and review analytics as Spark DataFrame jobs."""
