"""lectern: a PySpark-native document-processing engine."""
