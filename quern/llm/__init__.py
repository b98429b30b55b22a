"""Operators that prepare text and vectors for language models. Nothing else in the library imports this."""
