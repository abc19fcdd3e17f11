"""runforge: Spark-native embedding-corpus and training-run analytics."""
