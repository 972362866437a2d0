"""Spark-native trajectory, zone and matching analytics."""
