"""Queries over the test tables, grouped by operator family."""

from . import (
    aggregations, audits, expressions, filters, joins, profiles, rows, shapes, storage, verifications,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
