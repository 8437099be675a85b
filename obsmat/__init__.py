"""Spark-native analytics over large observation x feature matrices."""
