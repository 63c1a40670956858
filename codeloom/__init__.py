"""codeloom: a PySpark-native engine for code, text and markup collections."""

__version__ = "0.1.0"
