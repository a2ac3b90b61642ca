"""cairn: a Spark-native engine for versioned key-value change logs."""
