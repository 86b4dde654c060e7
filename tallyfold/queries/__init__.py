"""Every operator as a query over the given tables, with the same query in SQL."""

from . import aggregates, cells, columns, functions, graphs, incremental, joins, plans, sources, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
