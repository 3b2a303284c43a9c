"""pressloom: a PySpark-native analytics engine for news-coverage data."""

__version__ = "0.1.0"
