"""Operators that prepare text for language models; nothing outside imports this package."""
