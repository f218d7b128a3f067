"""A PySpark-native engine for spatial count tables and point-level data."""

__version__ = "0.1.0"
