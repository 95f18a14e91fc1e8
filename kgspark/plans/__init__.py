"""Registered queries, by topic. Importing a module registers its queries."""

from __future__ import annotations

import importlib

MODULES = ("texts", "graphs", "analytics", "layers", "pipelines")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"kgspark.plans.{name}")
