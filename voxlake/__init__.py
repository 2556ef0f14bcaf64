"""Spark-native analytics for imaging time series, volumes and run catalogues."""
