"""MinHash near-dedup with odd sketches.

Each set of word shingles gives two kinds of MinHash samples.  The minima under ``SAMPLES`` hash functions make the keys
under which sets meet, a band of ``ROWS`` minima each: two sets with four fifths in common miss each other in all
``BANDS`` bands with a chance of 1e-11.  The ``LOWEST`` least values under one hash function are folded into an odd
sketch, a bitmap in which each value flips one bit.  Equal values cancel in the XOR of two sketches, so its population
count is at most the number of samples that differ, and near it while they are few.  Pairs whose count can't come from
alike sets go before any set is read: of sets that are samples as a whole none is lost, of longer ones with a chance of
1e-9.  What is left is confirmed on the full sets, so no link is ever made by an estimate.

Sets that are equal are one node.  The nodes of a key are first compared with one of them, and what links is merged.
Keys that still hold several components are searched for pairs of different ones: a task compares the sketches of a
key (of two blocks of nodes, where the key holds many; two of its largest component never meet) and returns nearest
partners only, and only for the nodes outside the largest component of the key.  Confirmed links merge components.  The first rounds read a quarter of the
bands, the others all, with more partners each time, until every node has been given all it has.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell.llm.common import Scratch, WordHashes, bounded_broadcast, cut, mixed, texts
from ratewell.llm.components import connected

ROWS, BANDS, EARLY = 5, 64, 16
SAMPLES, LOWEST, BITS = ROWS * BANDS, 1024, 1024
#: Standard deviations that sampling, and folding, may be off.
SIGMAS = 6.0
#: Nodes of a block; nearest partners of a node in the first search, and how many times more in each further one.
BLOCK, FAN, WIDER = 1024, 4, 8
#: Blocks that a key's main component has at most, and its other nodes; pairs a search holds before it drops all but the nearest.
CELLS, PAIRS = 16, 1 << 21
#: Rows a search task holds at a time before it compares them, whole keys only.
HELD = 20_000

_draw = np.random.default_rng(20_250_701)
MULTIPLIERS = _draw.integers(1 << 31, 1 << 32, SAMPLES, np.uint64).astype(np.uint32) | np.uint32(1)
#: Factors that make one hash of the words of a shingle, of the minima of a band, and of a sample's number and minimum.
FACTORS = _draw.integers(1 << 63, (1 << 64) - 1, 64, np.uint64) | np.uint64(1)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the shingles of a word sequence; fewer words than ``width`` make one, none make none."""
    n = len(hashes)
    if n == 0:
        return hashes
    span = min(n, width)
    if span > len(FACTORS):
        raise ValueError(f"shingles of at most {len(FACTORS)} words")
    total = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        total += hashes[k:n - span + 1 + k] * FACTORS[k]
    return np.unique(mixed(total))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of a set under each hash function; ``found`` holds well mixed 64-bit hashes."""
    low, out = (found >> np.uint64(32)).astype(np.uint32), np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(out, np.multiply.outer(MULTIPLIERS, low[at:at + 1024]).min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key for each band of each row of minima."""
    parts = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64) * FACTORS[:ROWS]
    return mixed(parts.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * FACTORS[ROWS])


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """Bitmap (BITS / 64 words) of a set: the parity of how many of its LOWEST least values fall on each bit."""
    low = np.partition(found, LOWEST - 1)[:LOWEST] if len(found) > LOWEST else found
    odd = (np.bincount((mixed(low * FACTORS[0]) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def apart_limit(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Most bits in which the sketches of alike sets of ``n`` and ``m`` shingles differ.

    Alike sets have at least percent / (100 + percent) of n + m in common.  Of samples that are whole sets that says
    how many differ; of longer sets the share of the longer one is sampled.  Differing samples that fall on one bit
    cancel, which is where the folding adds its own chance; never more bits differ than samples.
    """
    common, longer = percent * (n + m) / (100 + percent), np.maximum(n, m)
    share = np.minimum(1.0, common / longer)
    sampled = LOWEST * share - SIGMAS * np.sqrt(LOWEST * share * (1 - share)) - 1
    both = np.where(longer <= LOWEST, common, np.minimum(sampled, common))
    differ = np.minimum(n, LOWEST) + np.minimum(m, LOWEST) - 2 * both
    odd = BITS / 2 * (1 - np.exp(-2 * differ / BITS))
    return np.floor(np.minimum(differ, odd + SIGMAS * np.sqrt(BITS) / 2 * np.sqrt(1 - np.exp(-4 * differ / BITS))) + 1e-9)


def alike(n: np.ndarray, m: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits in which sketches differ row by row, and whether sets of ``n`` and ``m`` shingles with them may be alike."""
    bits = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
    return bits, (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (bits <= apart_limit(n, m, percent))


def _words(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BITS // 64)


def _sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[int | None, np.ndarray]]:
    hashes = WordHashes()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            yield doc_id.as_py(), shingle_set(hashes.of((text.as_py() or "").encode().lower().split()), width)
            hashes.trim()


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, set size ``n``, ``digest`` of the set, its ``bands`` and its odd ``sketch`` (null for an empty set)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            ids, sizes, digests, samples, sketches = zip(*rows)
            keys = iter(band_keys(np.array([s for s in samples if s is not None], np.uint32).reshape(-1, SAMPLES)).view(np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()),
                 pa.array([None if s is None else next(keys) for s in samples], pa.list_(pa.int64())),
                 pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "n", "digest", "bands", "sketch"])

        for doc_id, found in _sets(batches, width):
            any_word = len(found) > 0
            rows.append((doc_id, len(found), xxhash.xxh3_128_digest(found.tobytes()) if any_word else None, minima(found) if any_word else None,
                         odd_sketch(found).view(np.int64) if any_word else None))
            if len(rows) == 1000:
                yield packed()
                rows.clear()
        if rows:
            yield packed()

    return texts(docs).mapInArrow(run, "doc_id long, n int, digest binary, bands array<long>, sketch array<long>")


def sketched(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow them to be alike."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
            _, may = alike(n, m, _words(batch.column("left")), _words(batch.column("right")), percent)
            yield batch.filter(pa.array(may)).select(["a", "b"])

    ends = nodes.select("node", "n", "sketch")
    return pairs.join(ends.toDF("a", "n_a", "left"), "a").join(ends.toDF("b", "n_b", "right"), "b").mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``docs`` whose full sets have at least ``percent`` of 100 in common."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, found in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([found.view(np.int64)], pa.list_(pa.int64()))], ["node", "shingles"])

    pairs = scratch.write(pairs)
    wanted = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct()
    full = scratch.write(docs.join(bounded_broadcast(wanted), "doc_id").mapInArrow(run, "node long, shingles array<long>"))
    common = F.size(F.array_intersect("left", "right"))
    found = cut(pairs.join(full.toDF("a", "left"), "a").join(full.toDF("b", "right"), "b")
                .where(100 * common >= percent * (F.size("left") + F.size("right") - common)).select("a", "b").distinct())
    scratch.release()
    return found


def _nearest(keys: np.ndarray, low: np.ndarray, high: np.ndarray, block: np.ndarray, node: np.ndarray, n: np.ndarray, label: np.ndarray,
             main: np.ndarray, sketch: np.ndarray, percent: int, fan: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, partner, bits apart): under each key the ``fan`` nearest partners of other components, nearest first.

    Rows lie cell by cell of a key; row i is compared with row i + d of its cell for d = 1, 2, ... in one step each.  A
    pair is given to the node outside the component ``main`` of the key, to the larger node if both are.  In a cell
    with ``low`` = ``high`` all meet; one with a negative ``low`` holds a block of ``main`` and one of others, which don't
    meet among themselves there; the rest hold two blocks of others.
    """
    new = np.r_[True, (keys[1:] != keys[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
    group = np.cumsum(new) - 1
    end = np.r_[np.flatnonzero(new)[1:], len(keys)][group]
    found, held, at, d = [], 0, np.arange(len(keys)), 1
    outer = label != main

    def nearest(i: np.ndarray, j: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((node[j], bits, node[i], group[i]))
        i, j, bits = i[order], j[order], bits[order]
        if len(i):
            first = np.r_[True, (node[i[1:]] != node[i[:-1]]) | (group[i[1:]] != group[i[:-1]])]
            place = np.arange(len(i)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            i, j, bits = i[place < fan], j[place < fan], bits[place < fan]
        return i, j, bits

    while len(at := at[at + d < end[at]]):
        other = at + d
        meet = (low[at] == high[at]) | np.where(low[at] < 0, outer[at] != outer[other], block[at] != block[other])
        apart = meet & (label[at] != label[other])
        i, j = at[apart], other[apart]
        bits, may = alike(n[i].astype(np.float64), n[j].astype(np.float64), sketch[i], sketch[j], percent)
        i, j, bits = i[may], j[may], bits[may]
        turned = (label[i] == main[i]) | (label[j] != main[j]) & (node[i] < node[j])
        found.append((np.where(turned, j, i), np.where(turned, i, j), bits))
        held, d = held + len(i), d + 1
        if held > PAIRS:
            found = [nearest(*(np.concatenate(x) for x in zip(*found)))]
            held = 0
    if not found:
        return (np.empty(0, np.int64),) * 3
    i, j, bits = nearest(*(np.concatenate(x) for x in zip(*found)))
    return node[i], node[j], bits


def _blocks(rows: Column) -> Column:
    """Blocks of ``BLOCK`` rows; no more than ``CELLS`` of them, which then hold more, so the copies made of a row stay bounded."""
    return F.least(F.lit(CELLS), F.ceil(rows / BLOCK)).cast("int")


def cells(lists: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the keys that hold several components, as often as they meet another block; a task searches a whole cell."""
    labelled = lists.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    ends = (labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("times")).groupBy("key")
            .agg(F.max(F.struct("times", "label")).alias("main"), F.sum("times").alias("members"), F.count(F.lit(1)).alias("several"))
            .where("several > 1").select(
                "key", F.col("main.label").alias("main"), _blocks(F.col("main.times")).alias("mains"),
                _blocks(F.col("members") - F.col("main.times")).alias("others")))
    # a node of the main component meets each block of others; another one each block of the main component, too
    with_others = F.expr("transform(sequence(0, others - 1), x -> struct(if(block = 0, x, -block) as low, x as high))")
    with_mains = F.expr("transform(sequence(0, mains - 1), x -> struct(if(x = 0, block, -x) as low, block as high))")
    with_rest = F.expr("transform(filter(sequence(0, others - 1), x -> x <> block), x -> struct(least(x, block) as low, greatest(x, block) as high))")
    inner = F.col("label") == F.col("main")
    return (labelled.join(ends, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.when(inner, F.col("mains")).otherwise(F.col("others"))).cast("int"))
            .select("key", "node", "label", "main", "block", F.explode(F.when(inner, with_others).otherwise(F.concat(with_mains, with_rest))).alias("meet"))
            .select("key", "meet.low", "meet.high", "block", "node", "label", "main")
            .join(nodes.select("node", "n", "sketch"), "node")
            .select("key", "low", "high", "block", "node", F.col("n").cast("long").alias("n"), "label", "main", "sketch"))


def nearest_of_others(lists: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int, fan: int) -> DataFrame:
    """(a, b, rank): the nearest nodes b of other components that a node a shares a key with, ``fan`` + 1 at most.

    Every pair under a common key that may be alike is among those of a or of b, unless that one has more than ``fan``.
    """
    rest = cells(lists, nodes, labels).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, waiting, size = ["key", "low", "high", "block", "node", "n", "label", "main"], [], 0

        def searched(columns: list[np.ndarray]) -> pa.RecordBatch:
            out = _nearest(*columns, percent, fan + 1)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "apart"])

        for batch in batches:
            waiting.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names] + [_words(batch.column("sketch"))])
            size += batch.num_rows
            if size >= HELD:
                columns = [np.concatenate(x) for x in zip(*waiting)]
                same = np.ones(size, bool)
                for x in columns[:3]:
                    same &= x == x[-1]
                whole = int(np.flatnonzero(~same).max()) + 1 if not same.all() else 0
                if whole:
                    yield searched([x[:whole] for x in columns])
                waiting, size = [[x[whole:] for x in columns]], size - whole
        if size:
            yield searched([np.concatenate(x) for x in zip(*waiting)])

    nearest = Window.partitionBy("a").orderBy("apart", "b")
    return (rest.mapInArrow(run, "a long, b long, apart long").groupBy("a", "b").agg(F.min("apart").alias("apart"))
            .withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= fan + 1).select("a", "b", "rank"))


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the smallest document reached by links), ``kept``: is it that one?

    Two documents link when 100 * common shingles >= percent * all shingles of both.  Null and empty texts, and
    texts without words, have no shingles and link with nothing.  Rows with the same ``doc_id`` are one document
    that has each of the texts; a row without ``doc_id`` gets the component of its equals and is kept only if it has
    none.  A long text is one set, whatever its length.  An empty table gives no rows; columns other than ``doc_id``
    and ``text`` are not read.
    """
    docs = texts(docs)
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.write(signatures(docs, width))
    copies = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    placed = (signed.join(bounded_broadcast(cut(copies.select("digest", "first"))), "digest", "left")
              .withColumn("node", F.when(F.col("digest").isNotNull(), F.coalesce("first", "doc_id"))))
    nodes = placed.where("node = doc_id").select("node", "n", "bands", "sketch")
    code = F.xxhash64("digest")
    several = placed.where("node is not null").groupBy("doc_id").agg(F.min(code).alias("low"), F.max(code).alias("high")).where("low < high").select("doc_id")
    own = (placed.where("doc_id <> node").join(bounded_broadcast(several), "doc_id")
           .select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct())

    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    hubs = (keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub"))
    lists = scratch.write(keyed.join(hubs, "key").select("key", "node", "hub", (F.col("band") < EARLY).alias("early")))
    scratch.release()
    stars = lists.where("early and node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = confirmed(sketched(stars, nodes, percent), docs, scratch, width, percent).unionAll(own)
    fan, early, more = FAN, True, True
    while more:
        labels = connected(links)
        own_lists = (lists.where("early") if early else lists).select("key", "node").distinct()
        near = scratch.write(nearest_of_others(own_lists, nodes, labels, percent, fan))
        more = early or not near.where(F.col("rank") > fan).isEmpty()
        pairs = near.where(F.col("rank") <= fan).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = confirmed(pairs, docs, scratch, width, percent)
        links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(found)
        fan, early = fan * WIDER, False
    labels = connected(links)
    out = cut(placed.select("doc_id", "n", "node").join(labels, "node", "left")
              .withColumn("component_id", F.coalesce("label", "node", "doc_id"))
              .select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))
    scratch.close()
    return out


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component; rows without ``doc_id`` stay.

    Of several rows of one document all stay, they are not copies under another id.  All columns are kept.
    """
    gone = near_duplicates(docs, width, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(gone, F.col("row.doc_id").cast("long") == F.col("gone_id"), "left_anti").select("row.*")
