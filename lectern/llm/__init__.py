"""Operators for training-data preparation on Spark; nothing else in the library imports them."""
