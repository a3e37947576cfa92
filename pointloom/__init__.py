"""Exact analytics over very large point-observation tables, on Spark DataFrames."""

from .table import Field, PointTable
from .session import configure, require_utc

__all__ = ["Field", "PointTable", "configure", "require_utc"]
