"""All registered queries of the analytics library and the SQL that answers them."""

from __future__ import annotations

from . import loads, relational, release, scores, streams, texts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
