"""Every operator as a named query over the given tables, with an independent SQL statement.

``registry`` holds them; the modules fill it on import.
"""

from meterbook.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "load"]


def load() -> None:
    """Import every catalog module once."""
    from meterbook.catalog import aggregates, checks, expressions, faults, joins, merging, sources, views  # noqa: F401
