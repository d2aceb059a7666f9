"""All queries outside the llm subpackage, with their DuckDB texts."""

from __future__ import annotations

from tidewright.plans import audit, catalogue, chains, ensembles, evaluation, models, more, relational, segments, serving, sources  # noqa: F401  importing a module registers its queries
from tidewright.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
