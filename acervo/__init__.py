"""acervo: a PySpark-native engine for curating and analysing scholarly records."""

__version__ = "0.1.0"
