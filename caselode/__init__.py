"""Spark-native retrieval, reranking and grounded-generation analytics."""
