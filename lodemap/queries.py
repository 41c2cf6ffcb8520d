"""All queries of the library and their SQL."""

from __future__ import annotations

from .plans import analysis, charts, profiles, retrieval, usage  # noqa: F401  each registers its queries
from .plans.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
