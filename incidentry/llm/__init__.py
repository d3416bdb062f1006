"""Operators for training-data pipelines: deduplication, filtering, mixing, sharding and file output over document tables."""
