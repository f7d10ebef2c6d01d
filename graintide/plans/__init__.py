"""Query plans by theme; importing a module registers its queries."""

from __future__ import annotations

import importlib

MODULES = ("relational", "estimators", "monitoring", "ordered", "forecasting", "tails", "ingestion", "repairs", "files", "series", "upkeep", "causal", "learning", "reports", "commodity", "advice")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"graintide.plans.{name}")
