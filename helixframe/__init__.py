"""Spark-native analytics for sequencing data, and operators for training-data pipelines."""
