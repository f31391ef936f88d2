"""Registered queries."""

from . import fact_queries, finding_queries, graph_queries, java_queries, plan_queries, review_queries, task_queries, capability_queries  # noqa: F401
