"""Registered queries over the driver tables, with their oracles."""

from tidewheel.catalog import series, reports, headlines  # noqa: F401
from tidewheel.catalog.registry import QUERIES

__all__ = ["QUERIES"]
