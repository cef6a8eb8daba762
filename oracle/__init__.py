"""Every named query once more, as plain SQL over the sample tables.

Written independently of the Spark code: one SELECT per query on top of CTEs
that spell out the canonical tables (see FIXTURES.md).
"""

from __future__ import annotations

from oracle import abandoned, customers, journey, loading, orders, products, revenue
from oracle.tables import with_tables

_PAGES = (loading, customers, journey, orders, abandoned, products, revenue)

ORACLE_SQL: dict[str, str] = {
    name: with_tables(sql) for page in _PAGES for name, sql in page.SQL.items()
}
