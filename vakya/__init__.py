"""vakya: a Spark-native engine for multilingual short-text analytics."""
