"""loamql: a Spark-native engine for a small SQL-like language with Python expressions."""

__version__ = "0.1.0"
