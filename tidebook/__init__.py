"""Spark-native analytics for uncertainty-aware market time series."""
