"""Spark-native segmentation, tracking and statistics of gridded vector fields."""
