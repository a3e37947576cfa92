"""Queries over the given tables, each with the SQL that must agree with it."""

from . import charts, filters, loads, rows, tables_joined  # noqa: F401
from .tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
