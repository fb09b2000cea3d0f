"""The registered queries, each beside SQL that gives the same rows."""

from . import aggregation, clicks, inout, relational, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
