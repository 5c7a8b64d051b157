"""Spark-native engine for reducing the storage of machine-learning model repositories."""

__version__ = "0.1.0"
