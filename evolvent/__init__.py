"""Spark-native analytics over the evolution of library APIs."""
