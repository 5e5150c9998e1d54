"""PySpark-native document retrieval engine."""
