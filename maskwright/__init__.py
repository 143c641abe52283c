"""maskwright: a PySpark-native privacy analytics engine (see README.md)."""
