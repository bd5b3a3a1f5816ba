"""Queries over the given tables, one per operator."""

import importlib

from . import registry

MODULES = ["metrics", "reports", "curation", "quality", "joins", "text", "vectors", "probes", "sources"]


def load():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return registry
