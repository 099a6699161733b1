"""Operators for large training-data pipelines: filtering, deduplication, scoring, mixing and encoding of documents."""
