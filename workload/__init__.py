"""Queries over the given tables, with oracle SQL, for the driver and the tests."""
from __future__ import annotations


def all_queries():
    from workload import audit_queries, legal_queries, monitor_queries, page_queries, text_queries  # noqa: F401
    from workload.registry import ORACLE, QUERIES
    return dict(QUERIES), dict(ORACLE)
