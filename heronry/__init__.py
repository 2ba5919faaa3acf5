"""heronry: a PySpark-native analytics engine for job-market crawl data."""

__version__ = "0.1.0"
