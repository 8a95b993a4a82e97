"""All checked queries; importing the category modules fills the registry."""

from __future__ import annotations

from prefspark.plans import cat_data, cat_objectives, cat_runs, cat_steps, cat_stream  # noqa: F401
from prefspark.plans.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
