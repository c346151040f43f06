"""Spark-native retrieval, answer-quality and corpus analytics."""
