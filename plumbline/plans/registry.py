"""All registered queries of the library and their oracle SQL."""

from __future__ import annotations

import plumbline.plans.file_queries  # noqa: F401  adds its own to the same tables
import plumbline.plans.stream_queries  # noqa: F401  so does this
from plumbline.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
