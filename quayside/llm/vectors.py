"""Which vectors take part, and their directions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(v: str) -> Column:
    """The array is there, not empty, and all its components are finite."""
    c = F.col(v)
    inf = float("inf")
    return F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1. Each is scaled by its largest component first, so that no square is too large or too small."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))
