"""All query modules."""

from __future__ import annotations

from quaystone.plans import catalog, q_content, q_demand, q_graph, q_history, q_pages, q_review, q_sources, q_text  # noqa: F401  registers on import


def queries():
    return catalog.QUERIES


def oracle_sql():
    return catalog.ORACLES
