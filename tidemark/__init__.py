"""Spark-native analytics for operational time series, logs, traces and change events."""
