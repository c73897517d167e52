"""Spark-native operators for catalogues of organisations, their web pages and policies."""
