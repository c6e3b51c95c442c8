"""trigrove: a Spark-native n-gram search engine over byte strings."""

__version__ = "1.0.0"
