"""Every catalog query by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import catalog, matching  # noqa: F401  they register their queries
from .common import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
