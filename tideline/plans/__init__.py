"""Registered queries: one module per operator family."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every query module so that it registers its queries."""
    for module in iter_modules(__path__):
        if module.name.startswith("q_"):
            import_module(f"{__name__}.{module.name}")
