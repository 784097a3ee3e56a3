"""Spark-native engine for evaluating document-grounded question answering."""
