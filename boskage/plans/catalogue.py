"""All registered queries and their SQL twins."""

from __future__ import annotations

from boskage.plans import analysis_queries, experiment_queries, geometry_queries, preparation, relational_queries

MODULES = [preparation, relational_queries, analysis_queries, experiment_queries, geometry_queries]


def queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= module.queries()
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.oracle_sql()
    return found
