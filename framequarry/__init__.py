"""Spark-native analytics over ordered frame streams and the tables around them."""
