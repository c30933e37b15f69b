"""lodeseam: a PySpark-native retrieval, knowledge and corpus-preparation engine."""

__version__ = "0.1.0"
