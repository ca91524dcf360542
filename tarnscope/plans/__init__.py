"""Bindings of the operators to tables, one module per family."""

from __future__ import annotations

import importlib
import pkgutil

from tarnscope.plans.registry import REGISTRY, Query


def load_all() -> dict[str, Query]:
    """Import every binding module and return the filled registry."""
    for info in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{info.name}")
    return REGISTRY
