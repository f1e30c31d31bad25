"""Hydropower revenue analytics as Spark DataFrame plans."""
