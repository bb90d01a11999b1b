"""Spark-native document retrieval and fact analytics."""
