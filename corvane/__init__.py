"""corvane: a Spark-native engine for hybrid evidence retrieval over document collections."""
