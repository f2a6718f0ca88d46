"""All registered queries, by part of the warehouse."""

from . import alerts, features, layers, quality, rollups, stats, streams  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
