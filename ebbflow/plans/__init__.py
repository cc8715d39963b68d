"""Registered queries: each pairs a Spark query with the SQL that checks it."""

from __future__ import annotations

import importlib

from ebbflow.plans.registry import QUERIES, Query

MODULES = ("calendar", "cleaning", "flows", "droughts", "no_flow", "frequency", "trends", "regions",
           "impacts")


def load() -> dict[str, Query]:
    """All registered queries by name."""
    for module in MODULES:
        importlib.import_module(f"ebbflow.plans.{module}")
    return dict(QUERIES)
