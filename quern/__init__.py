"""quern: a Spark-native engine for short-read sequence analytics."""
