"""emberline: a PySpark-native analytics engine for short crisis messages."""
