"""The queries of the engine and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("search_queries", "graph_queries", "code_queries", "docs_queries", "intel_queries", "state_queries", "catalog_queries", "generated_queries", "language_queries", "source_queries", "snapshot_queries")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"quarry.plans.{module}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
