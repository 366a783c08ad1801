"""weftline: Spark-native curation and ranking analytics over code and text corpora."""
