"""Registered queries."""

from __future__ import annotations

import importlib

_MODULES = ("labels", "features", "joins", "aggregates", "evaluate", "cases", "checks", "faults", "streams", "sources", "models")


def load():
    """Import every catalogue module once; return the plans and the SQL checks."""
    for name in _MODULES:
        importlib.import_module(f"tempora.catalog.{name}")
    from tempora.catalog.registry import CHECKS, PLANS

    return PLANS, CHECKS
