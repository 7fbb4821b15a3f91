"""Operators for training-data pipelines: filtering, deduplication, scans, mixing."""
