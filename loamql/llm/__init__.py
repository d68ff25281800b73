"""Operators for training-data work on language models. Nothing else in the library imports this."""
