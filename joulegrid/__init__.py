"""Spark-native analytics for hourly building-energy readings."""
