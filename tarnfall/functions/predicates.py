"""Predicates: six comparisons, AND, LIKE, NOT LIKE, IN."""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfall.functions.values import Bind, Value, value_of


class Predicate:
    def __init__(self, bind: Bind):
        self.bind = bind

    def __and__(self, other: "Predicate") -> "Predicate":
        return and_(self, other)


def typed_literal(kind: T.DataType, value: object) -> Column:
    """A constant of the compared column's own type, so that the comparison can be
    pushed to the scan: whole numbers are epoch days or epoch seconds."""
    if isinstance(kind, T.DateType) and isinstance(value, int):
        return F.lit(dt.date(1970, 1, 1) + dt.timedelta(days=value))
    if isinstance(kind, T.DateType) and isinstance(value, str):
        return F.lit(dt.date.fromisoformat(value))
    if isinstance(kind, T.TimestampNTZType) and isinstance(value, (int, str)):
        base = dt.datetime(1970, 1, 1)
        when = base + dt.timedelta(seconds=value) if isinstance(value, int) else dt.datetime.fromisoformat(value)
        return F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def _compare(op: Callable) -> Callable[[Value | str, object], Predicate]:
    def build(left: Value | str, right: object) -> Predicate:
        a = value_of(left)

        def bind(df: DataFrame) -> Column:
            if isinstance(right, Value):
                return op(a.bind(df), right.bind(df))
            return op(a.bind(df), typed_literal(a.data_type(df), right))

        return Predicate(bind)

    return build


equal = _compare(operator.eq)
not_equal = _compare(operator.ne)
less = _compare(operator.lt)
less_equal = _compare(operator.le)
greater = _compare(operator.gt)
greater_equal = _compare(operator.ge)


def and_(first: Predicate, *rest: Predicate) -> Predicate:
    def bind(df: DataFrame) -> Column:
        out = first.bind(df)
        for p in rest:
            out = out & p.bind(df)
        return out

    return Predicate(bind)


def like(expr: Value | str, pattern: str) -> Predicate:
    """SQL LIKE without an escape character: a backslash stands for itself."""
    v, p = value_of(expr), pattern.replace("\\", "\\\\")
    return Predicate(lambda df: v.bind(df).like(p))


def not_like(expr: Value | str, pattern: str) -> Predicate:
    p = like(expr, pattern)
    return Predicate(lambda df: ~p.bind(df))


def in_(expr: Value | str, values: Iterable[object]) -> Predicate:
    v, items = value_of(expr), list(values)

    def bind(df: DataFrame) -> Column:
        kind = v.data_type(df)
        return v.bind(df).isin(*[typed_literal(kind, x) for x in items])

    return Predicate(bind)
