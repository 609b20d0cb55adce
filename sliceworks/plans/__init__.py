"""Registered queries and the run catalogue."""

from __future__ import annotations

from importlib import import_module

MODULES = ("cleaning", "profiling", "splitting", "evaluation", "runs", "modelling")


def load_all() -> None:
    """Import every module that registers queries."""

    for name in MODULES:
        import_module(f"sliceworks.plans.{name}")
