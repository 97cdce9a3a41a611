"""Queries of the engine's own operators, gathered from the plan modules."""

from __future__ import annotations

import importlib

PLAN_MODULES: tuple[str, ...] = ("calendar", "text", "tables", "adapters", "cells", "raster", "ruled", "fields")


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    oracles: dict = {}
    for name in PLAN_MODULES:
        module = importlib.import_module(f"chronofold.plans.{name}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
