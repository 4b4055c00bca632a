"""folioflow: a PySpark-native engine for curating annotated page data."""
