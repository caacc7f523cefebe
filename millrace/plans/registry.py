"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from millrace.plans import aggregates, core, dataflow, diffs, extra, graphs, more, ordered, ranked, scalars, scripts, services, sources, spatial, states  # noqa: F401  importing a module registers its queries
from millrace.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
