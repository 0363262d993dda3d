"""Quillmark: retrieval and analytics over document corpora on Spark."""
