"""Spark-native preparation, quality control and KPI measurement of business tables."""
