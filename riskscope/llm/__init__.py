"""Operators for building training data at scale."""
