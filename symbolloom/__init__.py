"""symbolloom: Spark-native processing of versioned source-documentation data."""

__version__ = "0.1.0"
