"""Operators that prepare page corpora as training text. Nothing outside this package imports it."""
