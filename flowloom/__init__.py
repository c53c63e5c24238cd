"""Spark-native analytics over durable job-queue data."""
