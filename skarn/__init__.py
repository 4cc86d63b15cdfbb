"""Spark-native text retrieval and corpus analytics."""
