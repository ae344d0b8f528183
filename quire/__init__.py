"""quire: a Spark-native analytics engine for versioned text corpora."""
