"""Registered queries: each binds operators to the derived tables."""

from gridrun.queries.registry import ORACLES, QUERIES, oracle

__all__ = ["QUERIES", "ORACLES", "load_all", "oracle"]


def load_all() -> None:
    """Import every query module so that it registers itself."""
    import importlib
    import pkgutil

    for mod in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{mod.name}")
