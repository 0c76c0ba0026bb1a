"""Chatterloom: a PySpark-native analytics engine for tagged message corpora."""

__version__ = "0.1.0"
