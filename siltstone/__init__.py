"""siltstone: a PySpark-native engine for document retrieval analytics and corpus preparation."""
