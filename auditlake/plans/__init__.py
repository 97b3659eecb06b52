"""Named queries by topic."""

from __future__ import annotations

import importlib
import pkgutil


def catalog():
    """Every registered query and check text."""
    from auditlake.plans import registry

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.ORACLE
