"""Queries: operators bound to tables, each with an equivalent SQL statement."""
