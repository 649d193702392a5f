"""A Spark-native engine for document retrieval and analysis."""
