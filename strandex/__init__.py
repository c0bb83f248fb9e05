"""A PySpark-native analytics engine for macromolecular structures."""
