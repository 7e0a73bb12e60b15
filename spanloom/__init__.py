"""Spark-native text-privacy analytics: documents and character spans as DataFrames."""
