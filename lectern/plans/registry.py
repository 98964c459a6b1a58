"""All queries over the reference's own operators, by name, with the SQL for each."""

from __future__ import annotations

from . import markdown, runs  # noqa: F401  (they register their queries)
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
