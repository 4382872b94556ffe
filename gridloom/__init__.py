"""Spark-native numerical analytics on DataFrames."""
