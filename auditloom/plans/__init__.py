"""Named queries over the Parquet tables, each with an equivalent SQL text where SQL can express it."""

from __future__ import annotations

from . import content, details, facts, grammar, joins, links, measured, onpage, reports, resources, rollup, scalars, sites  # noqa: F401  each module registers its queries
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
