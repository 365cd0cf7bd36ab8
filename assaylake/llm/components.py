"""Connected components of links between labels: the core's alternating stars, over tables in the shared folder."""

from __future__ import annotations

from ..operators.graph import roots as components

__all__ = ["components"]
