"""Spark-native analytics: GPS tracks as DataFrames, and training-data operators in ``wakeline.llm``."""
