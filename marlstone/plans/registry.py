"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import catalog


def queries():
    return dict(catalog.QUERIES)


def oracle_sql():
    return dict(catalog.SQL)
