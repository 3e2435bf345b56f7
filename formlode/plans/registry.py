"""The registry of queries and helpers for their SQL counterparts."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame and, if there is one, the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r4(x: str, digits: int = 4) -> str:
    scale = f"{10**digits}::DOUBLE"
    return f"floor(({x}) * {scale} + 0.5::DOUBLE) / {scale}"


def rat(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE {r4(f'({a})::DOUBLE / ({b})::DOUBLE')} END"


def a4(x: str) -> str:
    """SQL form of rounding.mean()."""
    return r4(f"({r4(f'sum({x})', 6)}) / count({x})")
