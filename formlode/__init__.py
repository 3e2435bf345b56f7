"""Spark-native analytics over tables of submitted forms."""
