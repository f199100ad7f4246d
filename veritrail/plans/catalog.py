"""Collects the plan modules."""

from __future__ import annotations

from importlib import import_module

from veritrail.plans import registry

MODULES = ("oracle_base", "intake", "evidence", "dashboards", "history", "defense_eval", "graphs", "streams")


def _load() -> None:
    for name in MODULES:
        import_module(f"veritrail.plans.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def checks():
    _load()
    return {name: registry.with_views(sql) for name, sql in registry.CHECKS.items()}
