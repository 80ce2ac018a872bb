"""A Spark-native analytics engine over tables, points, text and vectors."""
