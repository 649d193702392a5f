"""Operators for preparing large text corpora as model training data."""
