"""A PySpark-native engine for analysing tables of embedding vectors."""

__version__ = "0.1.0"
