"""A Spark-native engine for preparing, indexing and querying collections of long documents."""
