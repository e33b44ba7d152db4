"""skeinframe: a Spark-native numerical analytics engine."""

__version__ = "0.1.0"
