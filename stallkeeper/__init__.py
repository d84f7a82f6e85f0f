"""stallkeeper: a PySpark-native catalog, entity-resolution and retrieval engine."""
