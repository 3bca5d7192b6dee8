"""Operators for building training corpora from web text; nothing else in the library imports this package."""
