"""name -> query and name -> DuckDB SQL, gathered from the plan modules."""

from __future__ import annotations

from . import checks, documents, evidence, graphs, records, shapes, sources  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
