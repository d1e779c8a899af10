"""A Spark-native engine for marked-up documents as ordered text segments."""
