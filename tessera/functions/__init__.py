"""A PySpark-native analytics engine for numeric columns, vectors and matrices."""
