"""Spark-native engine for literature-parameter extraction tables and their analytics."""
__version__ = "0.1.0"
