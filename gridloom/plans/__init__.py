"""The registered queries: one or more for each operator, with their SQL."""

from importlib import import_module

MODULES = ["vectors", "matrices", "scans", "batched", "solvers", "graphs", "ode", "files"]


def load():
    """(queries, oracle SQL) of all modules."""
    from . import registry

    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.ORACLE_SQL
