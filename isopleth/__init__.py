"""A PySpark-native analytics engine for chunked scientific and tabular collections."""
