"""Spark-native engine for localising and analysing collections of text files."""
