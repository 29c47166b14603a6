"""The named queries over the benchmark tables and their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def with_decimal_rounding(sql: str) -> str:
    """Round through DECIMAL, so that ties fall the same way in both engines."""
    out, i = [], 0
    for found in re.finditer(r"\bround\(", sql):
        if found.start() < i:
            continue
        depth, end = 1, found.end()
        comma = None
        while depth:
            ch = sql[end]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = end
            end += 1
        digits = sql[comma + 1:end - 1].strip() if comma else None
        out.append(sql[i:found.start()])
        inner = with_decimal_rounding(sql[found.end():comma or end - 1])
        if digits is None or not digits.isdigit():
            out.append(f"round({inner}{sql[comma:end - 1] if comma else ''})")
        else:
            out.append(f"CAST(round(CAST({inner} AS DECIMAL(38, {int(digits) + 4})), {digits}) AS DOUBLE)")
        i = end
    return "".join(out) + sql[i:]


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under *name*, with the SQL that must give the same rows."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_decimal_rounding(sql)
        return fn

    return add
