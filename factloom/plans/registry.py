"""All queries outside of the optional subpackages."""

from __future__ import annotations

from . import asof_plan, audit_plan, evidence_plan, general, graph_plan, measure_plan, page_plan

_MODULES = [general, asof_plan, audit_plan, evidence_plan, graph_plan, measure_plan, page_plan]


def queries() -> dict[str, general.Query]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
