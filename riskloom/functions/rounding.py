"""Rounding half up as plain arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUDGE = 1e-6


def half_up(x: Column | str, digits: int = 2) -> Column:
    """Round half up. A hair is added before cutting, so a value that is a tie on paper rounds the
    same whatever the last bits of its computation are. Stays in generated code."""
    c = F.col(x) if isinstance(x, str) else x
    scale = float(10 ** digits)
    return F.floor(c * scale + (0.5 + NUDGE)) / scale
