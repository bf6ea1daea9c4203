"""All registered queries and their SQL."""

from __future__ import annotations

from . import admission, briefing, catalog, evaluation, eventing, lookups, operations, reading, rules, upkeep  # noqa: F401  (each registers its queries with the catalog's)

QUERIES = dict(catalog.QUERIES)
ORACLE = dict(catalog.ORACLE)
