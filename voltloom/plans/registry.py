"""All queries of the analytics library and the SQL that checks them."""

from __future__ import annotations

from voltloom.plans import area_queries, interval_queries, report_queries, tariff_queries  # noqa: F401  (they register themselves)
from voltloom.plans.book import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
