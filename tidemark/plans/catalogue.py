"""The query catalogue: name -> (spark, sf_dir) -> DataFrame, and the SQL of each."""

from __future__ import annotations

from tidemark.plans import analysis, serving, stored, tending, texts, trends  # noqa: F401  (importing a module registers its queries)
from tidemark.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
