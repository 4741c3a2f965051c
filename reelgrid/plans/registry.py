"""The registered queries over the driver's tables, and the SQL that each is held against."""

from __future__ import annotations

from reelgrid.plans import film_queries, library_queries  # noqa: F401  they register their queries
from reelgrid.plans.queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
