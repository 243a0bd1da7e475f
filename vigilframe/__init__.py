"""A Spark-native engine for signal analytics."""
