"""Spark-native analytics for moving-object telemetry on a space-time grid."""

__version__ = "0.1.0"
