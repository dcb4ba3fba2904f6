"""corvane: a Spark-native engine for knowledge-retrieval analytics."""

__version__ = "0.1.0"
