"""Queries of the operators, for __spark_entry__.py: name -> plan, and name -> SQL check."""

from __future__ import annotations

import importlib

_MODULES = ("queries_text", "queries_pairs", "queries_model", "queries_scan")


def load():
    plans, checks = {}, {}
    for name in _MODULES:
        module = importlib.import_module(f"tempora.llm.{name}")
        plans |= module.PLANS
        checks |= module.CHECKS
    return plans, checks
