"""Bindings of the driver's tables, registered queries and their SQL oracles."""

from importlib import import_module

MODULES = [
    "chord_queries", "timeline_queries", "catalog_queries", "quality_queries", "signal_queries", "stream_queries",
]


def load() -> None:
    """Import every query module, which fills the registry."""
    for name in MODULES:
        import_module(f"stave.plans.{name}")
