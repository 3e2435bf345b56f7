"""Registered queries: adapters over the test tables composed with operators, and their SQL counterparts."""

from . import core, layout, scalars, values, vectors
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "core", "layout", "scalars", "values", "vectors"]
