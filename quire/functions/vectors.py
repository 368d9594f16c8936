"""Vector functions on ARRAY<DOUBLE> columns (F2, F3, F4) and their numpy
block forms used inside bounded Spark groups.

Arithmetic is always in double; FLOAT arrays are widened first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double_array(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("array<double>")


def dot(a, b) -> Column:
    a, b = as_double_array(a), as_double_array(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, x: s + x)


def l2_norm(a) -> Column:
    a = as_double_array(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda s, x: s + x * x))


def l2_normalize(a, eps: float = 1e-12) -> Column:
    """``x / max(||x||, eps)``; a zero vector stays zero."""
    a = as_double_array(a)
    n = F.greatest(l2_norm(a), F.lit(eps))
    return F.transform(a, lambda x: x / n)


def cosine(a, b) -> Column:
    """cosine similarity; 0 when either vector is zero (never NaN)."""
    na, nb = l2_norm(a), l2_norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


# ---- numpy forms, applied to one bounded block at a time -------------------


def np_normalize(m: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length; zero rows stay zero (cosine 0, not NaN)."""
    m = np.asarray(m, dtype=np.float64)
    if m.size == 0:
        return m
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def np_stack(series) -> np.ndarray:
    """A pandas Series of equal-length arrays as a 2-D float64 matrix; a null
    vector counts as zero (similarity 0 to all)."""
    rows = [None if v is None else np.asarray(v, dtype=np.float64) for v in series]
    width = next((len(v) for v in rows if v is not None), 0)
    if not rows or not width:
        return np.zeros((len(rows), width))
    return np.vstack([np.zeros(width) if v is None else v for v in rows])
