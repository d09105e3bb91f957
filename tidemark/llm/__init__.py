"""Operators for training-data pipelines over (doc_id, text, ...) tables."""
