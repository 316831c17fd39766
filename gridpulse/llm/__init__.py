"""Operators for training-data pipelines: one module per operator, queries and their SQL in ``queries``."""
