"""Null-aware arithmetic building blocks (Column in, Column out)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def rounded(x: Column, digits: int = 2) -> Column:
    """Round half up on the binary value: the same arithmetic in any SQL engine."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clamp(x: Column, low: float, high: float) -> Column:
    """Clip to [low, high]; null stays null (greatest/least alone would return the bound)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either side is null."""
    return F.when(b != 0, a / b)


def band(x: Column, bands: Sequence[tuple], value: int = 2, closed_top: float | None = None) -> Column:
    """First half-open [low, high) band that holds x; optionally the top edge itself belongs to the last band."""
    out = None
    for row in bands:
        low, high, label = row[0], row[1], row[value]
        hit = (x >= F.lit(float(low))) & (x < F.lit(float(high)))
        if closed_top is not None and float(high) == closed_top:
            hit = hit | (x == F.lit(float(closed_top)))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def weighted_mean(parts: Iterable[tuple[Column, float]]) -> Column:
    """Average over the non-null parts only; null when none is present. Added in the order given."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for value, w in parts:
        total = total + F.coalesce(value * F.lit(w), F.lit(0.0))
        weight = weight + F.when(value.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    return F.when(weight != 0, total / weight)


def mean_of(*values: Column) -> Column:
    return weighted_mean([(v, 1.0) for v in values])


def median_of(values: Sequence[Column], at_least: int) -> Column:
    """Median of the non-null values of a short fixed list."""
    kept = F.array_sort(F.array_compact(F.array(*values)))
    n = F.size(kept)
    low = F.try_element_at(kept, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(kept, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n >= at_least, (low + high) / F.lit(2.0))


def missing_as(x: Column, default: float) -> Column:
    """default where x is null or exactly zero (a zero score counts as missing in the risk terms)."""
    return F.when(x.isNull() | (x == 0), F.lit(float(default))).otherwise(x)
