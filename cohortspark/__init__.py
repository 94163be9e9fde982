"""Spark-native clinical cohort and feature analytics."""

__version__ = "0.1.0"
