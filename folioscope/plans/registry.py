"""Queries of the library by name, with their SQL."""

from __future__ import annotations

from . import queries as _queries
from . import scalars as _scalars
from . import streams as _streams
from . import structure as _structure


def queries():
    return _queries.QUERIES | _scalars.QUERIES | _streams.QUERIES | _structure.QUERIES


def oracle_sql():
    return _queries.SQL | _scalars.SQL | _streams.SQL | _structure.SQL
