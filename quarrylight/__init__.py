"""quarrylight: a PySpark-native engine for retrieval, cited answering and their measurement."""
