"""vellumine: a PySpark-native engine for indexing, searching and preparing document collections."""

__version__ = "0.1.0"
