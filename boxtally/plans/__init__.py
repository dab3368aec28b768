"""Named queries over the given tables."""

from __future__ import annotations

import importlib

_MODULES = ("metric_queries", "geometry_queries", "result_queries", "store_queries", "log_queries",
            "stream_queries")


def load_registry():
    """Import every query module and return the filled registry."""
    from boxtally.plans.catalog import REGISTRY

    for m in _MODULES:
        importlib.import_module(f"boxtally.plans.{m}")
    return REGISTRY
