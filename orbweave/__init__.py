"""Orbweave: embedding and training-data analytics as Spark jobs."""
