"""Operators for training-data pipelines, each a Spark job over whole tables."""
