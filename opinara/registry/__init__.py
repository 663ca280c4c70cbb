"""Named queries and their reference SQL, collected by `__spark_entry__`."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every module of this package and return (queries, oracles)."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    from opinara.registry.base import ORACLES, QUERIES

    return QUERIES, ORACLES
