"""Registered queries: each operator applied to the given tables, with the SQL that it is checked against."""

from __future__ import annotations

from traceforge.queries import anomaly, audit, compare, phases, plans, prep, qc, report, spc, spectral, steady, uncertainty  # noqa: F401  (each registers its queries)
from traceforge.queries.base import REGISTRY


def queries() -> dict:
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
