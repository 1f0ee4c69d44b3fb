"""All queries of the retrieval operators, gathered from the plan modules."""

from __future__ import annotations

from lanternfold.plans import evidence_plans, fusion_plans, graph_plans, memory_plans, surface_plans, text_plans, transition_plans, vector_plans
from lanternfold.registry import Plan

FLAGSHIP = "flagship_role_channels"
MODULES = (text_plans, fusion_plans, vector_plans, graph_plans, memory_plans, transition_plans, surface_plans, evidence_plans)


def queries() -> dict[str, Plan]:
    """The queries by name."""
    return {name: plan for m in MODULES for name, plan in m.R.plans.items()}


def oracle_sql() -> dict[str, str]:
    """The SQL of those queries that have one."""
    return {name: sql for m in MODULES for name, sql in m.R.sql.items()}
