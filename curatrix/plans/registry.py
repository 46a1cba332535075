"""Registry of the catalog queries; each module adds its queries and the SQL of the same results."""

from __future__ import annotations

from curatrix.plans import documents, pages, records, reports, upserts

MODULES: tuple = (pages, documents, records, upserts, reports)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
