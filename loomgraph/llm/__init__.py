"""Operators for training data. Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib
import pkgutil
from types import ModuleType


def query_modules() -> list[ModuleType]:
    """The modules of this subpackage that hold QUERIES and ORACLES, in order of name."""
    names = sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("p") and m.name.endswith("_queries"))
    return [importlib.import_module(f"{__name__}.{n}") for n in names]
