"""Exact order statistics, ranks and lookups that stay balanced when one group holds most rows.

A window ordered over a whole group runs in a single task.  That is the cheapest plan while no group
can exceed ``block_rows`` rows, so it is used whenever the input is no larger than that (``large``
False).  Otherwise every big group is cut into key ranges first: rows are numbered inside each range
and the sizes of the ranges before it are added, so the largest task holds one range and the result
is the same.

Tables broadcast here are bounded: groups above ``block_rows`` rows number at most
rows / block_rows, and their range borders at most twice that.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell.session import shared_folder

BLOCK_ROWS = 1_000_000
SAMPLES_PER_BLOCK = 20
#: Borders that a quantile sketch of a group gives, and the sketch's size (about a thousandth of the rows off at most).
GRID, SKETCH_SIZE = 1024, 4096


def is_large(df: DataFrame, block_rows: int = BLOCK_ROWS) -> bool:
    """Whether a group of ``df`` could exceed ``block_rows`` rows (one count job)."""
    return df.count() > block_rows


def spread(df: DataFrame, *keys: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` dealt out by ``keys``, to more tasks than the session's shuffles have where those would get more than ``rows``.

    For tables that are files or columns of them: their rows are counted first, from the files' footers.
    """
    tasks = -(-df.count() // rows)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(tasks, *keys)
    return df.repartition(*keys)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def match_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], size: str, spread: Sequence[str],
                 large: bool, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Left join on ``keys`` to a table with one row per key, where ``size`` counts the left rows of the key.

    For large inputs, keys above ``block_rows`` rows (few, so broadcast) are matched in place; their
    rows then travel through the join for the other keys spread by a hash of ``spread``, over as many
    salts as the key has blocks of ``block_rows`` rows.
    """
    keys = list(keys)
    values = [c for c in right.columns if c not in keys]
    if not large:
        return left.join(right, keys, "left").select(*left.columns, *values)
    heavy = right.where(F.col(size) > block_rows).select(*keys, F.struct(*values).alias("__heavy"))
    light = right.where(F.col(size) <= block_rows).select(
        *keys, F.lit(0).alias("__spread"), F.struct(*values).alias("__light"))
    salts = F.ceil(F.col(f"__heavy.{size}") / block_rows)
    tagged = left.join(F.broadcast(heavy), keys, "left").withColumn(
        "__spread",
        F.when(F.col("__heavy").isNotNull(), (F.pmod(F.xxhash64(*spread), salts) + 1).cast("int")).otherwise(0))
    joined = tagged.join(light, [*keys, "__spread"], "left")
    return joined.select(
        *left.columns,
        *[F.coalesce(F.col(f"__heavy.{c}"), F.col(f"__light.{c}")).alias(c) for c in values])


def _below(borders: str, key: Column) -> Column:
    """How many of the ascending ``borders`` (none: 0) are below ``key``, found by halving: a step for each doubling."""
    steps = F.sequence(F.floor(F.log2(F.greatest(F.size(borders), F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

    def step(at: Column, k: Column) -> Column:
        further = at + F.call_function("shiftleft", F.lit(1), k)
        return F.when(F.get(borders, further - 1) < key, further).otherwise(at)

    return F.when(F.col(borders).isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), step))


def with_range(df: DataFrame, groups: Sequence[str], value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``__block`` by a numeric value: rows of one group with smaller values never lie in a later block.

    Borders come from a mergeable quantile sketch of the group, of one size whatever the group holds: parts are
    sketched before the shuffle.  A group has ``GRID`` blocks at most, which then hold more than ``block_rows`` rows.
    """
    groups, number = list(groups), F.col(value).cast("double")
    blocks = F.least(F.lit(GRID), F.ceil(F.col("__n") / block_rows)).cast("int")
    grid = F.array(*[F.lit(i / GRID) for i in range(1, GRID)])
    borders = (
        df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"), F.kll_sketch_agg_double(number, SKETCH_SIZE).alias("__sketch"))
        .where(F.col("__n") > block_rows)
        .select(*groups, blocks.alias("__blocks"), F.kll_sketch_get_quantile_double("__sketch", grid).alias("__grid"))
        .select(*groups, F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("__blocks") - 1), lambda i: F.element_at(
            "__grid", F.greatest(F.lit(1), F.floor(i * (GRID / F.col("__blocks"))).cast("int"))))).alias("__borders"))
    )
    return (
        df.join(F.broadcast(borders), groups, "left")  # a row for each group above block_rows
        .withColumn("__block", _below("__borders", number))
        .drop("__borders")
    )


def with_block(df: DataFrame, groups: Sequence[str], key: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``__block``: rows of one group with smaller ``key`` never lie in a later block.

    For keys that are no numbers (structs that settle ties).  Borders come from a hash sample of about twenty keys
    per block; small groups stay whole in block 0, others have ``GRID`` blocks at most.
    """
    groups = list(groups)
    keyed = df.withColumn("__key", key)
    stride = max(1, block_rows // SAMPLES_PER_BLOCK)
    sample = F.when(F.pmod(F.xxhash64("__key"), F.lit(stride)) == 0, F.col("__key"))
    blocks = F.least(F.lit(GRID), F.ceil(F.col("__n") / block_rows)).cast("int")
    step = F.size("__keys") / blocks
    borders = (
        keyed.groupBy(*groups)
        .agg(F.count(F.lit(1)).alias("__n"), F.array_sort(F.collect_list(sample)).alias("__keys"))
        .where((F.col("__n") > block_rows) & (F.size("__keys") > 0))
        .select(*groups, F.array_distinct(F.transform(
            F.sequence(F.lit(1), blocks - 1),
            lambda i: F.element_at("__keys", F.greatest(F.lit(1), F.floor(i * step).cast("int"))))).alias("__borders"))
    )
    return (
        keyed.join(F.broadcast(borders), groups, "left")
        .withColumn("__block", _below("__borders", F.col("__key")))
        .drop("__borders")
    )


def block_offsets(blocked: DataFrame, groups: Sequence[str], weight: Column) -> DataFrame:
    """Weight before each block and weight of the whole group (one row per block)."""
    per_block = blocked.groupBy(*groups, "__block").agg(F.sum(weight).alias("__size"))
    ordered = Window.partitionBy(*groups).orderBy("__block")
    return per_block.select(
        *groups, "__block",
        (F.sum("__size").over(ordered) - F.col("__size")).alias("__before"),
        F.sum("__size").over(Window.partitionBy(*groups)).alias("n"))


def cumulative_counts(df: DataFrame, groups: Sequence[str], value: str, large: bool | None = None,
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per group and distinct value: ``cnt``, rows below (``below``), rows up to it (``upto``), group size ``n``.

    Equal values are counted before the first shuffle, so a value shared by most rows costs one row.
    """
    groups = list(groups)
    counted = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("cnt"))
    if large is None:
        counted = written(counted, "counted")
        large = is_large(counted, block_rows)
    elif large:
        counted = written(counted, "counted")
    if not large:
        running = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        ranked = counted.withColumn("upto", F.sum("cnt").over(running)).withColumn(
            "n", F.sum("cnt").over(Window.partitionBy(*groups)))
    else:
        blocked = with_range(counted, groups, value, block_rows)
        running = Window.partitionBy(*groups, "__block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        ranked = blocked.join(block_offsets(blocked, groups, F.col("cnt")), [*groups, "__block"]).withColumn(
            "upto", F.col("__before") + F.sum("cnt").over(running))
    return ranked.withColumn("below", F.col("upto") - F.col("cnt")).select(
        *groups, value, "cnt", "below", "upto", "n")


def ordinal_ranks(df: DataFrame, groups: Sequence[str], key: Column, rank: str, size: str, large: bool,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Position 1..n of every row in its group by ``key`` (unique per group), and n."""
    groups = list(groups)
    if not large:
        whole = Window.partitionBy(*groups)
        return df.withColumn(rank, F.row_number().over(whole.orderBy(key)).cast("long")).withColumn(
            size, F.count(F.lit(1)).over(whole))
    df = written(df, "ranked")  # read by four branches below
    blocked = with_block(df, groups, key, block_rows)
    inside = Window.partitionBy(*groups, "__block").orderBy("__key")
    return (
        blocked.join(block_offsets(blocked, groups, F.lit(1)), [*groups, "__block"])
        .withColumn(rank, (F.col("__before") + F.row_number().over(inside)).cast("long"))
        .withColumn(size, F.col("n").cast("long"))
        .select(*df.columns, rank, size)
    )


def value_at(position: Column, value: str) -> Column:
    """The value at zero-based ``position`` of the sorted group (aggregate over cumulative_counts rows)."""
    return F.max(F.when((F.col("below") <= position) & (position < F.col("upto")), F.col(value)))


def between(low: Column, high: Column, at: Column) -> Column:
    """Linear interpolation between two neighbours at the fractional position ``at``."""
    return low + (high - low) * (at - F.floor(at))


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, quantiles: dict[str, float],
                    large: bool | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Linearly interpolated quantiles of the non-null values, plus ``n``."""
    groups = list(groups)
    counts = cumulative_counts(df.where(F.col(value).isNotNull()), groups, value, large, block_rows)
    picks = [F.max("n").alias("n")]
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("n") - 1)
        picks += [value_at(F.floor(at), value).alias(f"__{name}_low"),
                  value_at(F.ceil(at), value).alias(f"__{name}_high")]
    picked = counts.groupBy(*groups).agg(*picks)
    return picked.select(*groups, "n", *[
        between(F.col(f"__{name}_low"), F.col(f"__{name}_high"), F.lit(q) * (F.col("n") - 1)).alias(name)
        for name, q in quantiles.items()])


def upper_median(df: DataFrame, groups: Sequence[str], value: str, name: str, large: bool | None = None,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Element n // 2 of the sorted non-null values: the upper of the two middle ones for even n."""
    counts = cumulative_counts(df.where(F.col(value).isNotNull()), groups, value, large, block_rows)
    return counts.groupBy(*groups).agg(value_at(F.floor(F.col("n") / 2), value).alias(name))
