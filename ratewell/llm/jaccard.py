"""N-gram Jaccard join: which documents share most of their word shingles, by a size-aware heavy-light join.

Equal sets are one node from the start.  All shingles have one global order, rarest first, so two sets that are
alike enough share the first shingles of what they have in common, and these lie near the front of both sets.

* Small (light) sets enumerate all 2-subsets of their front part: a partner must have one of the same 2-subsets.
* Large (heavy) sets would have too many; they scan the inverted lists of the single shingles of their front.
* The boundary is the set size where the estimated cost of enumerating passes that of scanning.  Sets up to
  1 / 0.85 of the boundary give 2-subsets and sets from the boundary on give single shingles, so two sets on
  different sides meet as well.

A list of documents with a common key isn't expanded into its pairs.  First each member is compared with one of
them, a few times over, and what links is merged into components.  Members of different components that are left
in a short list are then compared one by one.  Those of a long list meet by what sets them apart from its hub: two
alike sets either both link with the hub, or they share deviations from it (see ``_by_deviations``).  No link between
two components can be missed, and the copies within one are never paired.

Counts behind the order are kept in a sketch of bounded size, summed over all documents; any order gives the same
result, a good one gives short lists.  Shingles are 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratewell.llm.common import Scratch, WordHashes, bounded_broadcast, cut, mixed, texts
from ratewell.llm.components import connected

FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
                    0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
BLOCK = 1 << 14
#: Rounds in which the members of a list are compared with one of them, before the rest goes pair by pair.
STARS = 2
#: Longest list whose rest is compared pair by pair; longer ones go by deviations from their hub, with the same links.
SHORT = 64
#: Cost of comparing two sets, in costs of writing one key; share of the list partners a 2-subset still has.
COMPARE_COST, SUBSET_PARTNERS = 20.0, 0.1


def words(text: str) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split()


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every shingle of a word sequence; fewer words than ``width`` make one shingle, none make none."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < width:
        return mixed((hashes * FACTORS[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = hashes[:n - width + 1] * FACTORS[0]
    for k in range(1, width):
        total += hashes[k:n - width + 1 + k] * FACTORS[k]
    return mixed(total)


def profile(found: np.ndarray) -> np.ndarray:
    """Shingles by the first bits of their hash, 255 at most: the profiles of two sets differ by no more than the sets."""
    return np.minimum(np.bincount((found >> np.uint64(58)).astype(np.int64), minlength=64), 255).astype(np.int16)


def least_common(n, percent: int):
    """Least size of what a set of ``n`` shares with any partner at this similarity."""
    return (percent * n + 99) // 100


def front(n: int, percent: int, together: int) -> int:
    """Length of the front part that holds the first ``together`` common shingles of any two alike sets."""
    return n - least_common(n, percent) + together


def _each(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[int | None, np.ndarray]]:
    hashes = WordHashes()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            yield doc_id.as_py(), shingles(hashes.of(words(text.as_py() or "")), width)
            hashes.trim()


def shingle_counts(docs: DataFrame, width: int, percent: int, bits: int) -> tuple[np.ndarray, float, dict[int, int]]:
    """Order class by hash prefix (one byte each), mean partners in a front list, documents by set size.

    A shingle counts as often as it stands in a text.  The tables collected have fixed sizes: 2^bits counters, summed
    by Spark over all tasks, and a histogram of set sizes by steps of an eighth of their power of two.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lengths = np.zeros(1 << bits, np.uint32), {}
        for _, found in _each(batches, width):
            np.add.at(counts, (found >> np.uint64(64 - bits)).astype(np.int64), 1)
            if len(found):
                step = 1 << max(0, len(found).bit_length() - 4)
                lengths[len(found) // step * step] = lengths.get(len(found) // step * step, 0) + 1
        for at in range(0, 1 << bits, BLOCK):
            part = counts[at:at + BLOCK]
            if part.any():
                # byte by byte: the upper bytes of most counters are zero and pack well
                packed = zlib.compress(part.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([packed], pa.binary()), pa.array([None], pa.int64())], ["block", "counts", "n"])
        for p, n in lengths.items():
            yield pa.RecordBatch.from_arrays([pa.array([-1 - p], pa.int32()), pa.array([None], pa.binary()), pa.array([n], pa.int64())], ["block", "counts", "n"])

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        block = int(frame["block"].iloc[0])
        if block < 0:
            return pd.DataFrame({"block": [block], "counts": [None], "n": [int(frame["n"].sum())]})
        total = sum(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.uint64)
                    for x in frame["counts"])
        return pd.DataFrame({"block": [block], "counts": [total.tobytes()], "n": [None]})

    schema = "block int, counts binary, n long"
    rows = texts(docs).mapInArrow(run, schema).groupBy("block").applyInPandas(summed, schema).collect()
    counts, lengths = np.zeros(1 << bits, np.uint64), {}
    for row in rows:
        if row.block < 0:
            lengths[-1 - row.block] = row.n
        else:
            part = np.frombuffer(row.counts, np.uint64)
            counts[row.block * BLOCK:row.block * BLOCK + len(part)] = part
    mass = np.sort(counts).astype(np.float64)
    total = mass.sum()
    rare = mass[np.cumsum(mass) <= total * (1 - percent / 100)]
    noise = total / len(mass)
    partners = max(0.5, float((rare * rare).sum() / max(1.0, rare.sum()) - noise)) if len(rare) else 0.5
    return np.minimum(255, 8 * np.log2(counts.astype(np.float64) + 1)).astype(np.uint8), partners, lengths


def is_light(n: int, percent: int, heavy_from: int) -> bool:
    """Does a set of ``n`` shingles give 2-subsets?  Sets somewhat above the boundary do, to meet those below it."""
    return 100 * heavy_from > percent * n


def boundary(partners: float, lengths: dict[int, int], percent: int) -> int:
    """Smallest set size that counts as heavy: where the total cost over all documents is least.

    A set within 1 / similarity above the boundary pays for both kinds of keys, so a boundary just below a size that
    is frequent or large is dear; each size is also tried as the first that is far enough above it.
    """
    def cost(n: int, heavy_from: int) -> float:
        p = front(n, percent, 1)
        scan = p * (1 + COMPARE_COST * partners) if n >= heavy_from else 0
        subsets = p * (p + 1) / 2 * (1 + COMPARE_COST * partners * SUBSET_PARTNERS) if is_light(n, percent, heavy_from) else 0
        return scan + subsets

    tried = sorted({1, *lengths, *(max(1, percent * n // 100) for n in lengths)})
    return min(tried, key=lambda h: sum(times * cost(n, h) for n, times in lengths.items()))


def candidate_keys(found: np.ndarray, classes: np.ndarray, bits: int, percent: int, heavy_from: int) -> np.ndarray:
    """Keys of one set: 2-subsets of its front if light, single shingles of its front if heavy, both near the boundary.

    Sets that only an equal set can be like have no keys; equal sets have met before.
    """
    n = len(found)
    if n == 0 or least_common(n, percent) == n and 100 * n < percent * (n + 1):
        return np.empty(0, np.uint64)
    order = found[np.lexsort((found, classes[(found >> np.uint64(64 - bits)).astype(np.int64)]))]
    keys = []
    if is_light(n, percent, heavy_from):
        part = order[:front(n, percent, 2)]
        a, b = np.triu_indices(len(part), 1)
        keys.append(mixed(part[a] * FACTORS[2] + part[b]))
    if n >= heavy_from:
        keys.append(order[:front(n, percent, 1)])
    return np.unique(np.concatenate(keys))


def linked_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``: the smallest document a row reaches by links, itself included.

    Two documents link when 100 * common shingles >= percent * all shingles of both.  Null and empty texts, and
    texts without words, have no shingles and link with nothing.  Rows with the same ``doc_id`` are one document
    that has each of the texts; a row without ``doc_id`` gets the component of its equals (null if there are none).
    An empty table gives no rows; columns other than ``doc_id`` and ``text`` are not read.
    """
    spark = docs.sparkSession
    docs = texts(docs)
    bits = min(24, max(14, ceil(log2(8 * docs.count() + 1))))
    classes, partners, lengths = shingle_counts(docs, width, percent, bits)
    heavy_from = boundary(partners, lengths, percent)
    order = spark.sparkContext.broadcast(classes)  # 2^24 bytes at most
    scratch = Scratch(spark, "jaccard")

    def keyed_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def packed():
            ids, sizes, digests, profiles, keys = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()),
                 pa.array(profiles, pa.list_(pa.int16())), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n", "digest", "profile", "keys"])

        for doc_id, found in _each(batches, width):
            found = np.unique(found)
            digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
            rows.append((doc_id, len(found), digest, profile(found), candidate_keys(found, order.value, bits, percent, heavy_from).view(np.int64)))
            if len(rows) == 1000:
                yield packed()
                rows.clear()
        if rows:
            yield packed()

    sets = scratch.write(docs.mapInArrow(keyed_sets, "doc_id long, n int, digest binary, profile array<short>, keys array<long>"))
    first = cut(sets.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("members")))
    copies = (sets.select("doc_id", "digest").join(first.where("members > 1"), "digest")
              .where("doc_id <> node").select("doc_id", "digest").distinct())
    whole = sets.where("digest is not null and doc_id is not null")
    nodes = whole.join(bounded_broadcast(copies), ["doc_id", "digest"], "left_anti").withColumnRenamed("doc_id", "node")
    code = F.xxhash64("digest")
    several = whole.groupBy("doc_id").agg(F.min(code).alias("low"), F.max(code).alias("high")).where("low < high").select("doc_id")
    own = (whole.select("doc_id", "digest").join(bounded_broadcast(several), "doc_id").join(first, "digest")
           .where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct())
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    lists = scratch.write(keyed.join(shared, "key"))
    scratch.release()
    profiles = nodes.select("node", "n", "profile")
    links = _links(lists, profiles, docs, scratch, width, percent).unionAll(own)
    labels = connected(links)
    of_digest = (first.select("digest", "node").join(labels, "node", "left")
                 .select("digest", F.coalesce("label", "node").alias("component_id")))
    out = cut(sets.select("doc_id", "n", "digest").join(of_digest, "digest", "left")
              .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
    scratch.close()
    return out


def _links(lists: DataFrame, profiles: DataFrame, docs: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what is connected, out of lists (key, node, n) of documents with a common key."""

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are alike enough.

        Profiles rule out most: with d shingles in only one of two sets, common / all = (both - d) / (both + d),
        and d is at least the difference of the profiles.  The sets of the rest are made anew from their texts.
        """
        left, right = profiles.toDF("a", "n_a", "left"), profiles.toDF("b", "n_b", "right")
        apart = F.aggregate(F.zip_with("left", "right", lambda x, y: F.abs(x - y).cast("int")), F.lit(0), lambda s, x: s + x)
        both = F.col("n_a") + F.col("n_b")
        pairs = scratch.write(pairs.distinct().join(left, "a").join(right, "b")
                              .where(100 * (both - apart) >= percent * (both + apart)).select("a", "b"))
        wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b"))
        full = scratch.write(_sets_of(docs, wanted, width))
        left, right = full.toDF("a", "left"), full.toDF("b", "right")
        common = F.size(F.array_intersect("left", "right"))
        found = cut(pairs.join(left, "a").join(right, "b")
                    .where(100 * common >= percent * (F.size("left") + F.size("right") - common)).select("a", "b").distinct())
        scratch.release()
        return found

    links, labelled = None, lists.withColumn("label", F.col("node"))
    for _ in range(STARS):
        best = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct("label", "node", "n")).alias("hub"))
        mixed_lists = labelled.join(best.where("low < high").select("key", "hub"), "key")
        pairs = (mixed_lists.where("label <> hub.label").where(_near(F.col("n"), F.col("hub.n"), percent))
                 .select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")))
        found = verified(pairs)
        links = found if links is None else links.unionAll(found)
        labels = connected(links)
        labelled = lists.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    ends = (labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                        F.min(F.struct("label", "node")).alias("hub"), F.count(F.lit(1)).alias("members"))
            .where("low < high").select("key", F.col("hub.node").alias("hub"), "members"))
    rest = scratch.write(labelled.join(ends, "key"))
    short = rest.where(F.col("members") <= SHORT).select("key", "node", "n", "label")
    a, b = short.toDF("key", "a", "n_a", "label_a"), short.toDF("key", "b", "n_b", "label_b")
    pairs = a.join(b, "key").where("a < b and label_a <> label_b").where(_near(F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    stars, far_pairs = _by_deviations(rest.where(F.col("members") > SHORT).select("hub", "node", "label").distinct(), docs, scratch, width, percent)
    return links.unionAll(stars).unionAll(verified(pairs.unionAll(far_pairs)))


def _near(a, b, percent: int):
    """Are sets of these sizes near enough in size to be alike?"""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the documents in ``wanted`` (node), made from their texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, found in _each(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([np.unique(found).view(np.int64)], pa.list_(pa.int64()))], ["node", "shingles"])

    wanted = wanted.select(F.col("node").alias("doc_id")).distinct()
    return docs.join(bounded_broadcast(wanted), "doc_id").mapInArrow(run, "node long, shingles array<long>")


def _by_deviations(groups: DataFrame, docs: DataFrame, scratch: Scratch, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) to the hubs of groups (hub, node, label), and the pairs (a, b) of other members that may link.

    The deviations D of a set are the shingles that it or the hub's set has, but not both; the weight of a set of n
    shingles is w = (100 + percent) * |D| - (100 - percent) * n.  Two sets a and b link if and only if
    2 * (100 + percent) * |Da and Db| >= w(a) + w(b), and the hub, with no deviations, has the least weight of all
    sets.  So a and b without a common deviation link only where both link with the hub, and need not be paired.
    Of two members that don't both link with it, one has a weight above -w(hub), which says how many deviations
    they share at least.  Hence they share one among the first of both, rarest in the group first: of all but
    ``need - 1`` of each.  A partner that links with the hub needs a longer front from the other than one that doesn't.
    """
    over, under = 100 + percent, 100 - percent
    groups = scratch.write(groups)
    sets = scratch.write(_sets_of(docs, groups.select("node").unionAll(groups.select("hub")), width))
    centres = sets.join(groups.select(F.col("hub").alias("node")).distinct(), "node").groupBy("node").agg(F.min("shingles").alias("centre"))
    off = F.concat(F.array_except("shingles", "centre"), F.array_except("centre", "shingles"))
    members = (groups.join(sets, "node").join(centres.withColumnRenamed("node", "hub"), "hub")
               .select("hub", "node", "label", F.xxhash64("shingles").alias("version"), F.size("shingles").cast("long").alias("n"),
                       (under * F.size("centre").cast("long")).alias("reach"), off.alias("off"))
               .withColumn("d", F.size("off").cast("long")).withColumn("w", over * F.col("d") - under * F.col("n")))
    members = scratch.write(members.withColumn("linked", F.col("w") <= F.col("reach")))
    links = members.where("linked and node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))

    def need(*bounds):
        return F.greatest(F.lit(1), *[F.ceil(x) for x in bounds])

    with_linked = need((F.col("w") - F.col("reach")) / (2 * over), (F.col("w") - under * F.floor(100 * F.col("n") / percent)) / over)
    with_other = need((F.col("w") + F.col("reach") + 1) / (2 * over))
    placed = (members.withColumn("near_front", F.col("d") - with_other + 1)
              .withColumn("front", F.when(F.col("linked"), F.col("near_front")).otherwise(F.greatest("near_front", F.col("d") - with_linked + 1)))
              .withColumn("off", F.explode("off")))
    times = placed.groupBy("hub", "off").agg(F.count(F.lit(1)).alias("times"), F.min("label").alias("low"), F.max("label").alias("high"))
    rarest = Window.partitionBy("hub", "node", "version").orderBy("times", "off")
    fronts = scratch.write(placed.join(times, ["hub", "off"]).withColumn("place", F.row_number().over(rarest))
                           .where("place <= front and low < high")
                           .select("hub", "off", "node", "label", "n", "d", "w", "linked", (F.col("place") <= F.col("near_front")).alias("near")))
    left = fronts.where("not linked").toDF("hub", "off", "a", "label_a", "n_a", "d_a", "w_a", "linked_a", "near_a")
    right = fronts.toDF("hub", "off", "b", "label_b", "n_b", "d_b", "w_b", "linked_b", "near_b")
    pairs = (left.join(right, ["hub", "off"]).where("label_a <> label_b and (linked_b or near_a and near_b and a < b)")
             .where(_near(F.col("n_a"), F.col("n_b"), percent) & (F.col("w_a") + F.col("w_b") <= 2 * over * F.least("d_a", "d_b"))))
    return links, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def one_of_each(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component; rows without ``doc_id`` stay.

    Of several rows of one document all stay, they are not copies under another id.  All columns are kept.
    """
    found = linked_components(docs, width, percent)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(gone, F.col("row.doc_id").cast("long") == F.col("gone_id"), "left_anti").select("row.*")
