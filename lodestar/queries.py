"""The registered queries and their DuckDB SQL, gathered from the modules in ``plans``."""

from __future__ import annotations

import importlib
import pkgutil

from . import plans
from .plans.registry import ORACLES, QUERIES

for _module in pkgutil.iter_modules(plans.__path__):
    importlib.import_module(f"{plans.__name__}.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
