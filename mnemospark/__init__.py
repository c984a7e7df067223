"""A PySpark-native engine for hybrid retrieval, revision and curation of text records."""
