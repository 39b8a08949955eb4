"""Filter, aggregation, HAVING, ORDER BY, LIMIT and TOP-K.

Every operator returns a lazy DataFrame. A filter above a limit keeps the limit,
stacked filters are a conjunction, and empty inputs follow SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from tarnfall.functions.aggregates import Aggregate
from tarnfall.functions.predicates import Predicate
from tarnfall.functions.values import Value, value_of

Order = tuple[Value | str, str] | Value | str


def filter_(df: DataFrame, condition: Predicate) -> DataFrame:
    return df.where(condition.bind(df))


having = filter_


def _unique(names: Sequence[str]) -> None:
    if len(set(names)) < len(names):
        raise ValueError(f"repeated output names: {sorted({n for n in names if names.count(n) > 1})}")


def global_agg(df: DataFrame, *aggs: Aggregate) -> DataFrame:
    """One row, also over no input."""
    if not aggs:
        raise ValueError("no aggregates")
    _unique([a.alias for a in aggs])
    return df.agg(*[a.column(df) for a in aggs])


def group_by(df: DataFrame, keys: Sequence[Value | str], aggs: Sequence[Aggregate]) -> DataFrame:
    """Keys first, then aggregates, in the order given."""
    values = [value_of(k) for k in keys]
    if not values or any(not v.name for v in values):
        raise ValueError("group keys need names")
    _unique([v.name for v in values] + [a.alias for a in aggs])
    grouped = df.groupBy(*[v.column(df) for v in values])
    if not aggs:
        return df.select(*[v.column(df) for v in values]).distinct()
    return grouped.agg(*[a.column(df) for a in aggs])


def _orders(df: DataFrame, specs: Sequence[Order]) -> list[Column]:
    out = []
    for spec in specs:
        key, way = spec if isinstance(spec, tuple) else (spec, "asc")
        if way not in ("asc", "desc"):
            raise ValueError(f"direction must be asc or desc, not {way!r}")
        c = value_of(key).bind(df)
        out.append(c.desc() if way == "desc" else c.asc())
    if not out:
        raise ValueError("no order keys")
    return out


def order_by(df: DataFrame, *specs: Order) -> DataFrame:
    return df.orderBy(*_orders(df, specs))


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    if n < 0 or offset < 0:
        raise ValueError("limit and offset can't be negative")
    return (df.offset(offset) if offset else df).limit(n)


def top_k(df: DataFrame, specs: Sequence[Order], n: int, offset: int = 0) -> DataFrame:
    """A bounded heap per partition (TakeOrderedAndProject)."""
    return limit(order_by(df, *specs), n, offset)
