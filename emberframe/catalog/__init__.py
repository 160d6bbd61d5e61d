"""Registered queries, each with the SQL that states the same result on another engine."""

from __future__ import annotations

import importlib

MODULES = ("points", "environment", "imagery", "pixels", "scores", "flows", "spatial")


def load_all():
    """Import every catalog module and return ``(queries, oracles)``."""
    from emberframe.catalog import registry

    for module in MODULES:
        importlib.import_module(f"emberframe.catalog.{module}")
    return registry.QUERIES, registry.ORACLES
