"""All named queries and their SQL."""

from __future__ import annotations

from . import basics, chemistry, evaluation, exchange, funnels, grids, matching, modelling, names, records, review, study, sweeps, texts, values  # noqa: F401
from .registry import ORACLE, QUERIES

FLAGSHIP = "funnel_backcalc"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
