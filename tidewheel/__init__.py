"""Relative-strength rotation and supply-event analysis as PySpark DataFrame operators."""

__version__ = "0.1.0"
