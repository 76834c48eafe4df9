"""Every operator as a named query over the given tables, with its SQL twin."""

from __future__ import annotations

from importlib import import_module

from voxledger.catalog.registry import Registry, registry

MODULES = ("backlog", "metrics", "incidents", "text", "labels", "sources", "streams")


def load() -> Registry:
    """Import all query modules and return what they registered."""
    for name in MODULES:
        import_module(f"voxledger.catalog.{name}")
    return registry
