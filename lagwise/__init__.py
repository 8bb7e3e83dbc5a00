"""Spark-native analytics over many multivariate time series."""
