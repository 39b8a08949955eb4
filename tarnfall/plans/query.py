"""A fluent, lazy builder over one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tarnfall.functions.aggregates import Aggregate
from tarnfall.functions.predicates import Predicate
from tarnfall.functions.values import Value, value_of
from tarnfall.operators import relational as R
from tarnfall.sources.tables import scan


class Query:
    """Each step returns a new Query; ``df`` is the DataFrame so far."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def scan(cls, spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> "Query":
        return cls(scan(spark, path, columns))

    def as_view(self, name: str) -> "Query":
        """Also known to spark.sql() under a name."""
        self.df.createOrReplaceTempView(name)
        return self

    def select(self, *values: Value | str) -> "Query":
        return Query(self.df.select(*[value_of(v).column(self.df) for v in values]))

    def filter(self, *conditions: Predicate) -> "Query":
        df = self.df
        for c in conditions:
            df = R.filter_(df, c)
        return Query(df)

    def having(self, condition: Predicate) -> "Query":
        return self.filter(condition)

    def global_agg(self, *aggs: Aggregate) -> "Query":
        return Query(R.global_agg(self.df, *aggs))

    def group_by(self, keys: Sequence[Value | str], *aggs: Aggregate) -> "Query":
        return Query(R.group_by(self.df, keys, aggs))

    def order_by(self, *specs: R.Order) -> "Query":
        return Query(R.order_by(self.df, *specs))

    def limit(self, n: int, offset: int = 0) -> "Query":
        return Query(R.limit(self.df, n, offset))

    def top_k(self, specs: Sequence[R.Order], n: int, offset: int = 0) -> "Query":
        return Query(R.top_k(self.df, specs, n, offset))
