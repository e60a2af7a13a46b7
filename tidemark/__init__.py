"""tidemark: a PySpark-native engine for point-in-time event research."""
