"""Spark-native image analytics: rasters, metrics, policies and batch reports as DataFrames."""
