"""Registered queries over the test tables, each with an equivalent SQL text where one exists."""
from __future__ import annotations

import importlib
import pkgutil


def load_all():
    from . import registry
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{m}")
    return registry.QUERIES, registry.SQL, registry.COVERS
