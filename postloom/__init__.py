"""Spark-native analytics over forum-post corpora: ingest, cleaning, features, models."""
