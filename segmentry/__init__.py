"""Segment retrieval, its data preparation and evaluation as Spark DataFrame jobs."""
