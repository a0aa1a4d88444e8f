"""vantrail: a Spark-native analytics engine for archives of GPS flight tracks."""

__version__ = "0.1.0"
