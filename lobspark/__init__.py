"""PySpark-native order-book analytics."""
