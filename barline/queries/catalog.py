"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from . import book_queries, data_queries, measure_queries, panel_queries, signal_queries  # noqa: F401
from .registry import ORACLES, QUERIES

flagship = book_queries.flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
