"""Operators for training-data pipelines: ten components over a ``documents`` table."""
