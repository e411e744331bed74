"""docloom: a Spark-native engine for documentation corpora, retrieval and event streams."""
