"""Operators that prepare text and records for training data; nothing else in the library imports them."""
