"""Distances as column expressions, and as numpy kernels for blocks of rows.

Dense vectors are array<double>; binary vectors are sorted arrays of the positions of their set bits, of a stated length.
A distance that is 0/0 is NaN: it is never within a radius, not even of the point itself, and sorts last.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(NAN)).otherwise(top / bottom)


def cosine(a: Column, b: Column) -> Column:
    """1 - a.b / (|a| |b|); NaN for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(NAN)).otherwise(1 - dot(a, b) / norms)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def simd_bits(n: int) -> int:
    """How many leading bits a 256-bit kernel over n / 8 + 1 bytes, rounding its block count, covers."""
    size = n // 8 + 1
    return 256 * ((size + size % 32) // 32)


def yule(a: Column, b: Column, n: int, simd_compat: bool = False) -> Column:
    """2bc / (ad + bc) of the contingency table of two bit sets of length n.

    With simd_compat only the leading bits of whole 256-bit blocks are compared, and the rest count as unset in both.
    """
    if simd_compat:
        covered = simd_bits(n)
        a, b = (F.filter(x, lambda i: i < covered) for x in (a, b))
    both = F.size(F.array_intersect(a, b)).cast("double")
    only_a, only_b = F.size(a) - both, F.size(b) - both
    cross = only_a * only_b
    return _ratio(2 * cross, both * (n - both - only_a - only_b) + cross)


def sign_bits(v: Column) -> Column:
    """Positions of the positive components."""
    return F.filter(F.transform(v, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def bit_or(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def bit_and(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def bit_get(bits: Column, i: int) -> Column:
    return F.array_contains(bits, i)


def bit_set(bits: Column, i: int) -> Column:
    return F.array_sort(F.array_union(bits, F.array(F.lit(i))))


def bit_string(bits: Column, n: int) -> Column:
    """The bits as a string of 0 and 1, lowest position first."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.array_contains(bits, i), "1").otherwise("0")), "")


def is_sane(v: Column) -> Column:
    """A vector with components, of which some is not zero."""
    return F.coalesce((F.size(v) > 0) & F.exists(v, lambda x: x != 0), F.lit(False))


# ---- blocks of rows


def block(metric: str, a: np.ndarray, b: np.ndarray, n: int | None = None) -> np.ndarray:
    """All distances between the rows of a and of b.

    For yule the rows are 0 and 1, and n counts bits (default: the width); yule_simd compares the leading bits alone that
    a kernel of whole 256-bit blocks covers, and counts the rest as unset in both.
    """
    with np.errstate(invalid="ignore", divide="ignore"):
        if metric == "cosine":
            return 1 - (a @ b.T) / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :])
        if metric == "l2":
            return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2)) if a.shape[1] <= 8 else np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))
        if metric in ("yule", "yule_simd"):
            n = n or a.shape[1]
            if metric == "yule_simd":
                a, b = a[:, : simd_bits(n)], b[:, : simd_bits(n)]
            both = a @ b.T
            only_a, only_b = a.sum(1)[:, None] - both, b.sum(1)[None, :] - both
            cross = only_a * only_b
            return 2 * cross / (both * (n - both - only_a - only_b) + cross)
    raise ValueError(f"unknown metric {metric}")
