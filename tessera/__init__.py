"""Spark-native lossless-compression analytics."""
