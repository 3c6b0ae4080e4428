"""Spark-first analytics over event, fact and dimension tables."""
