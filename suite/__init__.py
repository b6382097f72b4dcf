"""Registered queries: one Spark callable and, where SQL can say it, one oracle each."""

from suite import indexing, notes, retrieval, search, sessions, sources, streams, upkeep  # noqa: F401
from suite.registry import REGISTRY

__all__ = ["REGISTRY"]
