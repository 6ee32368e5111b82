"""Operators for preparing training data: text, urls, archives, vectors. Nothing else in the library imports this package."""
