"""Spark-native analytics for libraries of digitised documents."""
