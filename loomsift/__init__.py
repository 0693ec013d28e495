"""loomsift: a PySpark-native engine that curates language-model training data."""

__version__ = "0.1.0"
