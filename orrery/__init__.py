"""A PySpark-native engine for vector search analytics."""
