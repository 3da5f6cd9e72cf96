"""Queries over the test tables, one per operator, with the SQL that must give the same rows."""

from . import insights, laws, merging, reading, scalars, signals, studies
from .common import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "insights", "laws", "merging", "reading", "scalars", "signals", "studies"]
