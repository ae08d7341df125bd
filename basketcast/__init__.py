"""Spark-native retail basket analysis, demand forecasting and inventory planning."""

__version__ = "0.1.0"
