"""Palimpsest: inspection and analytics of retrieved text, as Spark plans."""

__version__ = "0.1.0"
