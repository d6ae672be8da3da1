"""Queries and their SQL."""

from . import editor, maps, queries, training  # noqa: F401  (the others add their queries to those of queries)
