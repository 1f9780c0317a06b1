"""Registered queries: each runs one operator over the given tables, next to its check SQL."""

from __future__ import annotations

from importlib import import_module

from .registry import REGISTRY

_MODULES = (
    "sources",
    "filters",
    "joins",
    "graph",
    "paths",
    "retrieval",
    "training",
    "rollups",
    "validators",
    "windows",
    "scalars",
    "streams",
)


def load() -> dict:
    for name in _MODULES:  # registration happens on import
        import_module(f"{__name__}.{name}")
    return REGISTRY
