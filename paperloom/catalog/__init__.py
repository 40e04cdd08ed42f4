"""Catalogue of registered queries."""

from __future__ import annotations

import importlib

from paperloom.catalog.registry import REGISTRY

AREAS = ("structure", "retrieval", "triples", "graph", "literature", "answers", "monitoring", "streams")


def load_catalog():
    for area in AREAS:
        importlib.import_module(f"paperloom.catalog.{area}")
    return REGISTRY
