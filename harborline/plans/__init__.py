"""Compositions of the operators and the registered queries."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module so that its queries register."""
    for info in pkgutil.iter_modules(__path__):
        if info.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{info.name}")
