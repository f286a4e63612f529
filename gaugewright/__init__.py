"""A PySpark-native engine for building, validating, comparing and monitoring proxy scores."""

__version__ = "0.1.0"
