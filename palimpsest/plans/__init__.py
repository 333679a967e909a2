"""Queries of the engine."""

from . import import_queries, model_queries, more_queries, queries, upkeep_queries  # noqa: F401
