"""Corpus preparation and retrieval analytics as Spark plans."""
