"""A Spark-native text-retrieval and retrieval-evaluation engine."""
