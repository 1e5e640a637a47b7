"""Keyed merges: fill blanks, overwrite matches, keep one row per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_fill(base: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join that writes ``other``'s values into null cells only; creates absent columns."""
    have = set(base.columns)
    new = other.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return base.join(new, key, "left").select(
        *[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in base.columns],
        *[F.col(f"__{c}").alias(c) for c in columns if c not in have])


def merge_overwrite(base: DataFrame, other: DataFrame, key: str, columns: Mapping[str, str],
                    default=None) -> DataFrame:
    """Left join where non-null values of ``other`` replace the base cells.

    ``columns`` maps other-column -> base-column; new columns start as ``default``.  ``updated`` says
    whether the key was found.
    """
    have = set(base.columns)
    new = other.select(key, F.lit(True).alias("__hit"), *[F.col(s).alias(f"__{t}") for s, t in columns.items()])
    joined = base.join(new, key, "left")
    targets = list(columns.values())
    return joined.select(
        *[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in targets else F.col(c) for c in base.columns],
        *[F.coalesce(F.col(f"__{c}"), F.lit(default)).alias(c) for c in targets if c not in have],
        F.coalesce("__hit", F.lit(False)).alias("updated"))


def append_absent(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Base rows plus the extra rows whose key the base does not hold; columns are united by name."""
    return base.unionByName(extra.join(base.select(key), key, "left_anti"), allowMissingColumns=True)
