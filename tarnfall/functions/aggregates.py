"""Aggregates. Each takes (column or value, alias); the alias defaults to the name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfall.functions.values import Value, value_of


class Aggregate:
    def __init__(self, make: Callable[[DataFrame], Column], alias: str):
        self.make, self.alias = make, alias

    def column(self, df: DataFrame) -> Column:
        return self.make(df).alias(self.alias)


def _named(x: Value | str, alias: str | None) -> tuple[Value, str]:
    v = value_of(x)
    name = alias or v.name
    if not name:
        raise ValueError("an aggregate over an expression needs an alias")
    return v, name


def count(column: str = "*", alias: str | None = None) -> Aggregate:
    """Rows, whatever the column."""
    return Aggregate(lambda df: F.count(F.lit(1)), alias or ("c" if column == "*" else column))


def count_distinct(x: Value | str, alias: str | None = None) -> Aggregate:
    v, name = _named(x, alias)
    return Aggregate(lambda df: F.count_distinct(v.bind(df)), name)


def _pieces(c: Column, kind: T.DataType) -> list[tuple[Column, int]]:
    """(piece, its power of two) of an integer, so that the pieces' 64-bit sums can't
    overflow: before 2^47 rows of int16 and int32, and before 2^41 rows of int64."""
    if isinstance(kind, T.LongType):
        mask = F.lit((1 << 22) - 1).cast("bigint")
        return [(F.shiftright(c, 44), 44), (F.shiftright(c, 22).bitwiseAND(mask), 22), (c.bitwiseAND(mask), 0)]
    c = c.cast("bigint")
    if isinstance(kind, T.IntegerType):
        return [(F.shiftright(c, 16), 16), (c.bitwiseAND(F.lit((1 << 16) - 1).cast("bigint")), 0)]
    return [(c, 0)]


def _joined(pieces: list[tuple[Column, int]]) -> Column:
    """The total of summed pieces as decimal(38,0): once a group, not once a row."""
    out = None
    for piece, power in pieces:
        part = piece.cast("decimal(21,0)") * F.lit(1 << power).cast("decimal(14,0)")
        out = part if out is None else out + part
    return out.cast("decimal(38,0)")


def _wide_sum(c: Column, kind: T.DataType) -> Column:
    """An exact sum without decimals in the inner loop."""
    pieces = _pieces(c, kind)
    return F.sum(pieces[0][0]) if len(pieces) == 1 else _joined([(F.sum(x), power) for x, power in pieces])


def sum_(x: Value | str, alias: str | None = None) -> Aggregate:
    """A 64-bit sum; a total out of range is an error. SUM(c + k) of narrow integers is
    SUM(c) + k * COUNT(c), so any number of shifted sums costs one pass of two buffers."""
    v, name = _named(x, alias)

    def make(df: DataFrame) -> Column:
        if v.shift is not None:
            base, k = v.shift
            if isinstance(base.data_type(df), (T.ShortType, T.IntegerType)) and abs(k) < 2**31:
                b = base.bind(df)
                return F.sum(b.cast("bigint")) + F.count(b) * F.lit(k).cast("bigint")
        return _wide_sum(v.bind(df), v.data_type(df)).cast("bigint")

    return Aggregate(make, name)


def min_(x: Value | str, alias: str | None = None) -> Aggregate:
    v, name = _named(x, alias)
    return Aggregate(lambda df: F.min(v.bind(df)), name)


def max_(x: Value | str, alias: str | None = None) -> Aggregate:
    v, name = _named(x, alias)
    return Aggregate(lambda df: F.max(v.bind(df)), name)


def avg_trunc(x: Value | str, alias: str | None = None) -> Aggregate:
    """The exact sum divided by the count, truncated toward zero; null over no rows."""
    v, name = _named(x, alias)

    def make(df: DataFrame) -> Column:
        c = v.bind(df)
        rows = F.count(c)
        total = _wide_sum(c, v.data_type(df))
        return F.when(rows > 0, F.call_function("div", total, F.greatest(rows, F.lit(1).cast("bigint")))).cast("bigint")

    return Aggregate(make, name)


def avg(x: Value | str, alias: str | None = None) -> Aggregate:
    """SQL AVG as double."""
    v, name = _named(x, alias)
    return Aggregate(lambda df: F.avg(v.bind(df)), name)


#: String spellings: one function serves every type.
str_count_distinct, str_min, str_max = count_distinct, min_, max_
