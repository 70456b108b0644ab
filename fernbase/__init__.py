"""fernbase: a PySpark-native document-table engine."""

__version__ = "0.1.0"
