"""corpuscle: a PySpark-native engine for sentence-aligned multilingual text corpora."""

__version__ = "0.1.0"
