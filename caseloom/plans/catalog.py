"""All registered queries outside the corpus operators, with their SQL."""

from __future__ import annotations

from . import assembly, history, lookups, measures, nightly, pools, projection, runs, scoring, texts, wholes  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

FLAGSHIP = "A2_hit_rate_wilson"
