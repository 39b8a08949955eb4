"""The query builder and the query sets."""
