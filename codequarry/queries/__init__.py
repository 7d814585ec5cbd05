"""Registered queries: each module holds QUERIES (name -> function) and ORACLES (name -> SQL)."""

MODULES = ("texts", "tables", "linking", "graphs", "programs", "components")


def load() -> tuple[dict, dict]:
    """All queries and oracle statements of the library's own operators."""
    from importlib import import_module

    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
