"""All registered queries, grouped the way the operators are."""

from assayer.plans.catalog import decisions, fits, flows, guards, metrics, scalars, selection, sources, splits  # noqa: F401
from assayer.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
