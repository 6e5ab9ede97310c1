"""A PySpark engine for curating and analysing language-model training data."""

__version__ = "0.2.0"
