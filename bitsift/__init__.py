"""Bitsift: similarity search over 256-bit binary codes as Spark DataFrame plans."""

__version__ = "0.1.0"
