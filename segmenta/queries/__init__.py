"""All queries, each beside its SQL twin."""

from segmenta.plans.registry import QUERIES, SQL
from segmenta.queries import aggregates, arrays, joins, learning, predicates, scalars, signal, sources, statistics, windows

__all__ = ["QUERIES", "SQL", "aggregates", "arrays", "joins", "learning", "predicates", "scalars", "signal", "sources", "statistics", "windows"]
