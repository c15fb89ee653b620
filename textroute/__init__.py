"""Spark-native routing and quality analytics over tables of free-text records."""
