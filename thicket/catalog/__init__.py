"""Registered queries: every operator run on the driver's tables."""

from thicket.catalog import build, expressions, graph, questions, retrieval, triples  # noqa: F401
from thicket.catalog.registry import ENTRIES

__all__ = ["ENTRIES"]
