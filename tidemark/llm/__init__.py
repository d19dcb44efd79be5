"""Operators for text corpora and vectors. Nothing else in the library imports this package."""
