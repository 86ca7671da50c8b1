"""Registered queries over the given tables, each with an independent SQL check."""

from importlib import import_module

MODULES = ["health", "pairs", "evidence", "quality", "publication", "lifecycle",
           "catalog", "ledger", "streams"]


def load_all() -> None:
    """Import every module of registered queries."""
    for name in MODULES:
        import_module(f"runlumen.plans.{name}")
