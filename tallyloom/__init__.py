"""Spark-native analytics over cross-sections, time series, portfolios and options."""
