"""Spark-first retrieval, evidence fusion, observability and evaluation operators."""
