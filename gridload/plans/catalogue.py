"""All registered queries and their SQL twins."""

from __future__ import annotations

from gridload.plans import (  # noqa: F401  (imported for their registrations)
    file_queries,
    learning_checks,
    learning_queries,
    preparation_queries,
    quality_queries,
    response_queries,
    scoring_queries,
    selection_queries,
    series_queries,
)
from gridload.plans.registry import ORACLE, QUERIES, Query
from gridload.session import configure


def _prepared(fn: Query) -> Query:
    def run(spark, sf_dir):
        return fn(configure(spark), sf_dir)

    return run


def all_queries() -> dict[str, Query]:
    return {name: _prepared(fn) for name, fn in QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return dict(ORACLE)
