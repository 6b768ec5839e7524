"""A Spark-native engine that cleans, matches and profiles tables."""
