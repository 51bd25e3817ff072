"""All queries of the core, and their SQL."""

from __future__ import annotations

from framelode.plans import analytics, base, catalogue, policies, relational, retrieval, texts  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
