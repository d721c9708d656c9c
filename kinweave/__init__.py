"""Spark-native entity resolution, gallery analytics and corpus preparation."""
