"""skillweave: a Spark-native engine for competency, qualification and occupation data."""

__version__ = "0.1.0"
