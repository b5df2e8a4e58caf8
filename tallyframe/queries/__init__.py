"""Registered queries: every operator at work on the given tables, with its SQL equivalent."""

from tallyframe.queries import aggregates, joining, profiling, projecting, reconciling, selecting, stepping  # noqa: F401
from tallyframe.queries.registry import REGISTRY

__all__ = ["REGISTRY"]
