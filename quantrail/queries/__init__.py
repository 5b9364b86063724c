"""Queries over the tables, by name, with the SQL that checks them."""

from . import decisions, finance, matrices, runs, series, sheets, simulation, sources, statistics  # noqa: F401
from .common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
