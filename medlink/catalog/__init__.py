"""Registered queries, each next to the SQL it must agree with."""

from __future__ import annotations

import importlib

from medlink.catalog import registry

MODULES = ("text_queries", "matching_queries", "curation_queries", "case_queries")


def load() -> tuple[dict, dict]:
    """Import every query module once; returns (queries, oracle SQL)."""
    for name in MODULES:
        importlib.import_module(f"medlink.catalog.{name}")
    return registry.QUERIES, registry.ORACLES
