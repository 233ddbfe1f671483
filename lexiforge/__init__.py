"""Spark-native text retrieval, corpus analytics and data-quality jobs."""
