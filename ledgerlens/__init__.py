"""ledgerlens: Spark-native analytics for labelled banking activity logs."""

__version__ = "0.1.0"
