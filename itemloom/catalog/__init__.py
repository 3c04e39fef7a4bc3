"""Registered queries, grouped by area."""

from __future__ import annotations

import importlib

MODULES = ["profile_queries", "model_queries", "curation_queries", "media_queries"]


def load():
    """Import every query module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"itemloom.catalog.{name}")
    return importlib.import_module("itemloom.catalog.base")
