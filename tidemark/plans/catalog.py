"""Every named query of the library, and its DuckDB counterpart."""

from . import expressions, relational, searches, versioned, windowed  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
