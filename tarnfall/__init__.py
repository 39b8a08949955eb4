"""Spark-native analytics over wide event tables: typed CSV ingestion, a lazy
query builder on DataFrames, and a 43-query workload."""

from tarnfall.plans.query import Query
from tarnfall.session import build_session
from tarnfall.sources.tables import convert, read_csv, scan

__all__ = ["Query", "build_session", "convert", "read_csv", "scan"]
