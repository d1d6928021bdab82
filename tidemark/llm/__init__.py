"""Operators for preparing text, vector and media tables for model training."""
