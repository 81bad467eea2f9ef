"""corpusmill: a PySpark-native engine for document corpora and retrieval tables."""
