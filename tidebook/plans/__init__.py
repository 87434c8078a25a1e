"""End-to-end plans and the registry of queries."""

from __future__ import annotations

from importlib import import_module

#: Modules that register queries.
MODULES = ("market", "features", "models", "trading", "streams", "layout")


def load():
    """The registry with all queries in it."""
    for name in MODULES:
        import_module(f"tidebook.plans.{name}")
    return import_module("tidebook.plans.registry")
