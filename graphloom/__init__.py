"""A PySpark-native engine for code property graphs."""
