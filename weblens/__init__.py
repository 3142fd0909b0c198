"""Spark-native web-log behaviour analytics."""
