"""Relational operators as functions on DataFrames."""

from tarnfall.operators.relational import filter_, global_agg, group_by, having, limit, order_by, top_k

__all__ = ["filter_", "global_agg", "group_by", "having", "limit", "order_by", "top_k"]
