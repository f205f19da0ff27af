"""frameledger: Spark-native evaluation analytics over time-aligned, spatial and textual predictions."""
__version__ = "0.1.0"
