"""Operators for training-data pipelines: matching, text forms, survivorship, leakage, mixing, personal data."""
