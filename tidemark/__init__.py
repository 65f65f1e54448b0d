"""tidemark: a Spark-native engine for one embedded SQL dialect over versioned tables."""

__version__ = "0.1.0"
