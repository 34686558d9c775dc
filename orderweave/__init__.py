"""A Spark-native record-linkage and order-normalisation engine."""
