"""Registered queries with their SQL equivalents."""

from __future__ import annotations

import importlib

MODULES = ["shaping", "parsing", "joining", "aggregating", "retrieval", "mapping", "details", "running", "rules", "exchange", "files"]


def registry():
    queries, oracles = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"formloom.plans.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
