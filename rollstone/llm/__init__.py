"""Operators for training data made of text and sets. Nothing outside this package imports it."""
