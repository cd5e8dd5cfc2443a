"""Operators for training-text corpora. Nothing else in the library imports this subpackage."""
