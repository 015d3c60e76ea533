"""netloom: a Spark-native analytics engine for network flows."""
