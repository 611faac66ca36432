"""Registered queries over the driver's tables, and the same results in DuckDB SQL."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """Queries and their SQL by name."""
    from parley.plans import evaluation, meetings, profiles, signals, speakers, streams, texts, timeline  # noqa: F401
    from parley.plans.registry import QUERIES, SQL

    return QUERIES, SQL
