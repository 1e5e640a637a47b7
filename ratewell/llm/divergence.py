"""Source divergence audit: how far the term use of each source is from the other sources of its language.

Terms are counted once for every (lang, source) group.  From the counts come smoothed whole shares p of one billion, and
from these two reports: the distance of each source to every other source of the language (``pair``), and the terms
that set a source apart from its language (``term``).

The leading terms come from a dominance skyband.  A term that is as frequent in the group, as rare in the language
and earlier in UTF-8 than another ranks before it whatever the sizes of the group and the language are.  So each
partition keeps, of its terms of a group, those that fewer than k others dominate: a superset of the first k, known
before any share is.  Skybands of parts are merged the same way (the skyband of a union lies in the union of the
skybands), in pieces of bounded size, and only what is left is ranked exactly.

Distances are summed over buckets of terms and blocks of sources: a task holds one bucket for two blocks, and a
pair of sources has one row for each bucket at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell.llm.common import Scratch, bounded_broadcast, cut

#: Share of a term that is all of a text, and what is added to every count.
UNIT, SMOOTH = 1_000_000_000, 5
#: Bytes of a text that are cut into terms at a time; counters a task holds before it passes them on.
PIECE, HELD = 1 << 22, 400_000
#: Rows of a group that one skyband is made from, term rows of a bucket, sources of a block.
BAND_ROWS, BUCKET_ROWS, BLOCK_SOURCES = 8192, 4096, 128

#: A-Z in lower case, every other ASCII byte that is no letter as a blank.
_TO_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """Runs of letters A-Z, a-z and non-ASCII characters of a text, A-Z lower-cased, in lists of bounded size."""
    plain = text.encode().translate(_TO_TERMS)
    start = 0
    while start < len(plain):
        end = len(plain) if len(plain) - start <= PIECE else plain.find(b" ", start + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, uses, docs): one row for each term of a group, and one without term for each group.

    Null text, lang and source count as ''.  Every row is a document, also those that repeat a ``doc_id``.
    """
    parts = "lang string, source string, term string, uses long, docs long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[tuple[str, str], Counter] = {}
        holders: dict[tuple[str, str], Counter] = {}

        def packed() -> Iterator[pa.RecordBatch]:
            for (lang, source), counted in uses.items():
                names = [None, *(t.decode() for t in counted)]
                times = [0, *counted.values()]
                held = [0, *map(holders[lang, source].__getitem__, counted)]
                for at in range(0, len(names), 50_000):
                    n = len(names[at:at + 50_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(names[at:at + n], pa.string()),
                         pa.array(times[at:at + n], pa.int64()), pa.array(held[at:at + n], pa.int64())],
                        ["lang", "source", "term", "uses", "docs"])

        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                group, own = (lang, source), set()
                if group not in uses:
                    uses[group], holders[group] = Counter(), Counter()
                    size += 1
                counted, before = uses[group], len(uses[group])
                for found in terms(text.as_py()):
                    counted.update(found)
                    own.update(found)
                holders[group].update(own)
                size += len(counted) - before
                if size > HELD:
                    yield from packed()
                    uses, holders, size = {}, {}, 0
        yield from packed()

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    return (docs.select(plain("lang"), plain("source"), plain("text")).mapInArrow(run, parts)
            .groupBy("lang", "source", "term").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs")))


def share(uses: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (uses + SMOOTH) / (total + SMOOTH * kept)) in whole numbers of any size; 0 where no term is kept."""
    whole = f"(cast({uses} as decimal(20,0)) + {SMOOTH}) * {UNIT}bd div nullif(cast({total} as decimal(20,0)) + {SMOOTH} * cast({kept} as decimal(20,0)), 0bd)"
    return F.coalesce(F.expr(f"cast(1 + {whole} as long)"), F.lit(0).cast("long"))


def in_band(count: np.ndarray, total: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Which terms do fewer than ``k`` others dominate, by a higher count, a lower total and an earlier name?

    In the order by count, total and name all dominators of a term stand before it.  A term with k dominators has k
    of them in the skyband, so it is enough to count among the kept ones.
    """
    order = np.lexsort((names, total, -count))
    total, place = total[order], np.argsort(np.argsort(names))[order]
    kept = np.empty(0, np.int64)
    for at in range(0, len(order), 256):
        new = np.arange(at, min(at + 256, len(order)))
        earlier = np.concatenate([kept, new])
        above = (total[earlier] <= total[new, None]) & (place[earlier] < place[new, None]) & (earlier < new[:, None])
        kept = np.concatenate([kept, new[above.sum(axis=1) < k]])
    return order[kept]


def skyband(rows: DataFrame, k: int) -> DataFrame:
    """Rows (lang, source, term, uses, lang_uses) that may be among the first ``k`` of their group, partition by partition."""
    names = ["lang", "source", "term", "uses", "lang_uses"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[pd.DataFrame]] = {}
        sizes: Counter = Counter()

        def reduced(group: tuple[str, str]) -> None:
            frame = pd.concat(held[group])
            frame = frame.iloc[in_band(frame["uses"].to_numpy(), frame["lang_uses"].to_numpy(), frame["term"].to_numpy(), k)]
            held[group], sizes[group] = [frame], len(frame)

        def packed() -> Iterator[pa.RecordBatch]:
            for group in list(held):
                reduced(group)
                yield pa.RecordBatch.from_pandas(held.pop(group)[0], preserve_index=False)
            sizes.clear()

        limits: Counter = Counter()
        for batch in batches:
            for group, frame in batch.to_pandas().groupby(["lang", "source"], sort=False):
                held.setdefault(group, []).append(frame[names])
                sizes[group] += len(frame)
                if sizes[group] > max(BAND_ROWS, limits[group]):
                    reduced(group)
                    limits[group] = 2 * sizes[group]  # a band that hardly shrinks isn't made anew for each batch
            if sizes.total() > HELD:
                yield from packed()
        yield from packed()

    return rows.select(*names).mapInArrow(run, "lang string, source string, term string, uses long, lang_uses long")


def leading(rows: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """Skybands of the groups of ``rows``, merged in pieces until they are small or no longer shrink."""
    band = scratch.write(skyband(rows, k))
    while True:
        sizes = band.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("size"))
        most, total = sizes.agg(F.max("size"), F.sum("size")).first()
        if not most or most <= BAND_ROWS:
            return band
        pieces = F.ceil(F.col("size") / BAND_ROWS)
        merged = band.join(bounded_broadcast(sizes), ["lang", "source"]).withColumn("piece", F.pmod(F.xxhash64("term"), pieces))
        band = scratch.write(skyband(merged.repartition("lang", "source", "piece"), k))
        if band.count() > 0.8 * total:
            return band


def _distances(rows: pd.DataFrame, unit_rows: pd.DataFrame) -> Iterator[tuple[str, str, int]]:
    """For each pair of sources the sum of |p - q| over the terms in ``rows``, less what their base shares would give."""
    sources = unit_rows["source"].to_numpy()
    base = unit_rows["base"].to_numpy(np.int64)
    at_term, _ = pd.factorize(rows["term"])
    at_source = pd.Index(sources).get_indexer(rows["source"])
    table = np.repeat(base[:, None], at_term.max() + 1 if len(at_term) else 0, axis=1)
    table[at_source, at_term] = rows["p"].to_numpy(np.int64)
    block = unit_rows["block"].to_numpy()
    low, high = block.min(), block.max()
    for i in np.flatnonzero(block == low):
        others = np.flatnonzero(block == high) if low != high else np.arange(i + 1, len(sources))
        if len(others):
            apart = np.abs(table[others] - table[i]).sum(axis=1) - np.abs(base[others] - base[i]) * table.shape[1]
            yield from zip([sources[i]] * len(others), sources[others], apart.tolist())


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): both directions of every pair of sources of a language."""
    blocks = groups.groupBy("lang").agg((F.ceil(F.count(F.lit(1)) / BLOCK_SOURCES)).cast("int").alias("blocks"), F.sum("rows").alias("lang_rows"))
    sources = (groups.join(blocks, "lang").withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("lang_rows") / BUCKET_ROWS)).cast("int"))
               .withColumn("block", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / BLOCK_SOURCES).cast("int")))
    meets = F.expr("explode(transform(sequence(0, blocks - 1), b -> struct(least(b, block) as low, greatest(b, block) as high)))").alias("meet")
    placed = sources.select("lang", "source", "block", "blocks", "buckets")
    term_rows = (shares.select("lang", "source", "term", "p").join(bounded_broadcast(placed), ["lang", "source"])
                 .select("lang", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "source", "block", "term", "p", F.lit(0).cast("long").alias("base"), meets))
    unit_rows = (sources.select("lang", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), "source", "block", "blocks", "base")
                 .select("lang", "bucket", "source", "block", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), "base", meets))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        units, found = frame["term"].isna(), frame["term"].notna()
        rows = list(_distances(frame[found], frame[units]))
        names = pd.DataFrame([(key[0], a, b) for a, b, _ in rows], columns=["lang", "a", "b"], dtype=object)
        return names.assign(value=np.array([value for *_, value in rows], np.int64))

    own = term_rows.unionByName(unit_rows).select("lang", "bucket", "meet.low", "meet.high", "source", "block", "term", "p", "base")
    sums = (own.groupBy("lang", "bucket", "low", "high").applyInPandas(run, "lang string, a string, b string, value long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    ends = groups.select("lang", "source", "base", "kept")
    whole = (sums.join(bounded_broadcast(ends.toDF("lang", "a", "base_a", "kept")), ["lang", "a"])
             .join(bounded_broadcast(ends.drop("kept").toDF("lang", "b", "base_b")), ["lang", "b"])
             .withColumn("value", F.col("value") + F.col("kept") * F.abs(F.col("base_a") - F.col("base_b"))))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return whole.select("lang", F.explode(both).alias("e"), "value").select("lang", "e.source", "e.item", "value")


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources (``pair``) and leading terms (``term``).

    Each language keeps the terms that ``least_docs`` of its documents hold.  ``rank`` counts from 1 in each group and
    part, by value downwards, then item in UTF-8 order; of the terms the first ``top`` are given.  Null text, lang
    and source read as ''; texts without terms make a group as well; very long texts are cut into terms piece by piece;
    repeated rows count each time.  An empty table gives no rows.  Other columns than text, lang and source aren't read.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    counted = scratch.write(term_counts(docs))
    of_term = Window.partitionBy("lang", "term")
    kept = scratch.write(counted.where("term is not null").withColumn("lang_docs", F.sum("docs").over(of_term)).withColumn("lang_uses", F.sum("uses").over(of_term))
                         .where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "uses", "lang_uses"))
    scratch.release()
    langs = kept.groupBy("lang").agg(F.count_distinct("term").alias("kept"), F.sum("uses").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("uses").alias("total"), F.count(F.lit(1)).alias("rows"))
    groups = scratch.write(counted.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
                           .na.fill(0).withColumn("base", share("0", "total", "kept")))
    sizes = bounded_broadcast(groups.select("lang", "source", "total", "kept", "lang_total"))
    shares = kept.join(sizes, ["lang", "source"]).withColumn("p", share("uses", "total", "kept"))
    pairs = _pairs(shares, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    first = (leading(kept, top, scratch).join(sizes, ["lang", "source"])
             .withColumn("value", share("uses", "total", "kept") - share("lang_uses", "lang_total", "kept")).where("value > 0")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(first.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top))
    out = cut(ranked.withColumn("rank", F.col("rank").cast("int")))
    scratch.close()
    return out
