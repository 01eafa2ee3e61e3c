"""Named queries over the supplied tables, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> dict:
    """Import every plan module once and return the query registry."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    from contrasieve.plans.registry import QUERIES

    return QUERIES
