"""Expressions: values, predicates and aggregates."""
