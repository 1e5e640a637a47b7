"""Document fingerprints by invertible Bloom lookup sketches.

A text is cut into paragraphs at line ends, and inside long ones after words chosen by their last bytes, so an edit
moves few cuts.  What is longer than ``LONG`` bytes all the same (no blanks, or the same words again and again) is cut
where a rolling hash of the last ``WINDOW`` bytes says so, into pieces of ``SMALLEST`` to ``LARGEST`` bytes.  Each paragraph (and which repetition it is) has a 64-bit digest.  A sketch adds every digest to
three cells: a count, the xor of the digests, the xor of their checks.  The difference of two sketches holds only what
the texts don't share; peeling cells with a single digest recovers those digests.  If the peeling gets stuck, sketches
four times as large are made, until it succeeds.  All documents of a block are peeled together in numpy.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.common import Scratch, mixed, texts

HASHES, CELLS, GROW = 3, 8, 4
BLOCK_CHARS = 2_000_000
#: Bytes: pieces beyond the first are cut further; window of the rolling hash; limits of what that makes.
LONG, WINDOW, SMALLEST, LARGEST = 512, 12, 32, 256
#: One place in so many is a cut.
SELDOM = np.uint64(64)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def paragraph_digests(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, digest) of every paragraph of the texts; equal paragraphs of a text are told apart by number."""
    raw = [t.encode() for t in found]
    sizes = np.array([len(r) for r in raw], np.int64)
    b = np.frombuffer(b"".join(raw), np.uint8)
    if not len(b):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ends = np.cumsum(sizes)
    cut = b == 10
    blank = np.flatnonzero(b[3:] == 32) + 3
    blank = blank[blank - (ends - sizes)[np.searchsorted(ends, blank, "right")] >= 3]  # the three bytes are the text's own
    cut[blank[(b[blank - 1].astype(np.int64) * 31 + b[blank - 2].astype(np.int64) * 17 + b[blank - 3]) % 8 == 0]] = True
    cut[ends[sizes > 0] - 1] = True
    power = np.full(len(b) + 1, MULTIPLIER)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[b] * power[:-1], dtype=np.uint64)])
    inverse = np.full(len(b) + 1, np.uint64(pow(int(MULTIPLIER), -1, 1 << 64)))
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    stop = np.flatnonzero(cut) + 1
    start = np.concatenate([[0], stop[:-1]])
    far = stop - start > LONG
    for x, y in zip(start[far].tolist(), stop[far].tolist()):
        cut[_inner_cuts(total[x:y + 1], inverse[x:y + 1]) + x - 1] = True
    stop = np.flatnonzero(cut) + 1
    start = np.concatenate([[0], stop[:-1]])
    digest = mixed((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64) * SALTS[0])
    owner = np.searchsorted(ends, start, "right")
    order = np.lexsort((digest, owner))
    digest, owner = digest[order], owner[order]
    new = np.concatenate([[True], (digest[1:] != digest[:-1]) | (owner[1:] != owner[:-1])])
    at = np.arange(len(digest))
    return owner, mixed(digest + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) * SALTS[1])


def _inner_cuts(total: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Ends of the pieces inside one piece, but for the last; by its running hashes before each byte and at its end."""
    n = len(total) - 1
    rolling = mixed((total[WINDOW:] - total[:-WINDOW]) * inverse[:-WINDOW])
    chosen = np.flatnonzero(rolling % SELDOM == 0) + WINDOW
    ends, at, k = [], 0, 0
    while n - at > SMALLEST:
        k += int(np.searchsorted(chosen[k:], at + SMALLEST))
        at = min(at + LARGEST, int(chosen[k]) if k < len(chosen) else n)
        if at < n:
            ends.append(at)
    return np.array(ends, np.int64)


def sketches(owner: np.ndarray, digest: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digests and checks of ``n`` sketches of ``HASHES * cells`` cells, in one row each."""
    size = HASHES * cells
    count, key, check = np.zeros(n * size, np.int64), np.zeros(n * size, np.uint64), np.zeros(n * size, np.uint64)
    _add(count, key, check, owner, digest, cells, 1)
    return count.reshape(n, size), key.reshape(n, size), check.reshape(n, size)


def _add(count, key, check, owner, digest, cells, sign) -> None:
    mark = mixed(digest ^ SALTS[2])
    for k in range(HASHES):
        at = owner * (HASHES * cells) + k * cells + (mixed(digest + SALTS[k]) % np.uint64(cells)).astype(np.int64)
        np.add.at(count, at, sign)
        np.bitwise_xor.at(key, at, digest)
        np.bitwise_xor.at(check, at, mark)


def peeled(count, key, check, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many digests each difference of two sketches gives, -1 where the peeling gets stuck; and these digests.

    The digests come as (difference, digest, side); side 1 is the sketch subtracted from, -1 the subtracted one.
    Those of a stuck difference are left out.
    """
    n, size = count.shape
    count, key, check = count.ravel().copy(), key.ravel().copy(), check.ravel().copy()
    found, rows = np.zeros(n, np.int64), []
    while True:
        pure = np.flatnonzero(((count == 1) | (count == -1)) & (mixed(key ^ SALTS[2]) == check))
        if not len(pure):
            break
        owner, digest, sign = pure // size, key[pure], count[pure]
        order = np.lexsort((digest, owner))  # a digest may be alone in several of its cells
        owner, digest, sign = owner[order], digest[order], sign[order]
        first = np.concatenate([[True], (digest[1:] != digest[:-1]) | (owner[1:] != owner[:-1])])
        owner, digest, sign = owner[first], digest[first], sign[first]
        np.add.at(found, owner, 1)
        rows.append((owner, digest, sign))
        _add(count, key, check, owner, digest, cells, -sign)
    stuck = ((count != 0) | (key != 0)).reshape(n, size).any(axis=1)
    owner, digest, side = (np.concatenate(x) for x in zip((np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)), *rows))
    whole = ~stuck[owner]
    return np.where(stuck, -1, found), owner[whole], digest[whole], side[whole]


def differences(owner: np.ndarray, digest: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Number of digests that only one of texts ``left[k]`` and ``right[k]`` has, by sketches that grow until they peel."""
    return differing(owner, digest, left, right, n, False)[0]


def differing(owner: np.ndarray, digest: np.ndarray, left: np.ndarray, right: np.ndarray, n: int, keep: bool = True) -> tuple[np.ndarray, ...]:
    """The numbers of ``differences``; and, to ``keep``, the digests as (k, digest, side), 1 of ``left[k]``, -1 of ``right[k]``."""
    rows = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))]
    out, open_pairs, cells = np.full(len(left), -1), np.arange(len(left)), CELLS
    starts = np.searchsorted(owner, np.arange(n + 1))
    while len(open_pairs):
        used = np.unique(np.concatenate([left[open_pairs], right[open_pairs]]))
        inside = np.concatenate([np.arange(starts[u], starts[u + 1]) for u in used]) if len(used) else np.empty(0, np.int64)
        count, key, check = sketches(np.searchsorted(used, owner[inside]), digest[inside], len(used), cells)
        step = max(1, 2_000_000 // (HASHES * cells))
        for a in range(0, len(open_pairs), step):
            part = open_pairs[a:a + step]
            x, y = np.searchsorted(used, left[part]), np.searchsorted(used, right[part])
            out[part], at, apart, side = peeled(count[x] - count[y], key[x] ^ key[y], check[x] ^ check[y], cells)
            if keep:
                rows.append((part[at], apart, side))
        open_pairs, cells = np.flatnonzero(out < 0), cells * GROW
    return out, *(np.concatenate(x) for x in zip(*rows))


def differing_paragraphs(pairs: DataFrame) -> DataFrame:
    """``pair_id``, ``digest``, ``side`` of every paragraph that only one of the texts of (pair_id, left, right) has.

    ``side`` is 1 for a paragraph of the left text, -1 for one of the right.  Null texts are empty.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("pair_id", "left", "right")]
            a = 0
            while a < len(columns[0]):
                b, size = a, 0
                while b < len(columns[0]) and (b == a or size < BLOCK_CHARS):
                    size += len(columns[1][b] or "") + len(columns[2][b] or "")
                    b += 1
                n = b - a
                owner, digest = paragraph_digests([t or "" for t in columns[1][a:b] + columns[2][a:b]])
                _, at, apart, side = differing(owner, digest, np.arange(n), np.arange(n) + n, 2 * n)
                yield pa.RecordBatch.from_arrays([pa.array([columns[0][a + k] for k in at], pa.int64()), pa.array(apart.view(np.int64), pa.int64()),
                                                  pa.array(side, pa.int32())], ["pair_id", "digest", "side"])
                a = b

    rows = pairs.select(F.col("pair_id").cast("long").alias("pair_id"), F.col("left").cast("string").alias("left"), F.col("right").cast("string").alias("right"))
    return rows.mapInArrow(run, "pair_id long, digest long, side int")


def _written(count, key, check) -> list[str]:
    rows = np.concatenate([count.astype("<i4").view(np.uint8).reshape(len(count), -1), key.astype("<u8").view(np.uint8).reshape(len(count), -1),
                           check.astype("<u8").view(np.uint8).reshape(len(count), -1)], axis=1)
    return [base64.b85encode(r.tobytes()).decode() for r in rows]


def compare_block(found: list[str], following: list[str]) -> list[tuple]:
    """Result columns of each text and the text that follows it."""
    edited = [t[:len(t) - len(t) // 2] + f[:len(t) // 2] for t, f in zip(found, following)]
    n = len(found)
    every = found + edited + following
    owner, digest = paragraph_digests(every)
    sizes = np.bincount(owner, minlength=3 * n)
    at = np.arange(n)
    left, right = np.concatenate([at, at]), np.concatenate([at + n, at + 2 * n])
    apart = differences(owner, digest, left, right, 3 * n)
    shared = (sizes[left] + sizes[right] - apart) / 2
    near = np.where(shared + apart > 0, shared / np.maximum(shared + apart, 1), 1.0)
    own = owner < 2 * n
    prints = _written(*sketches(owner[own], digest[own], 2 * n, CELLS))
    return [(len(t), hashlib.sha256(e.encode()).hexdigest(), prints[k], prints[n + k], float(near[k]), float(near[n + k]))
            for k, (t, e) in enumerate(zip(found, edited))]


KINDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
         "near_edited": pa.float64(), "near_next": pa.float64()}
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(ids: list, rows: list[tuple], **more) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 6
    arrays = [pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, list(KINDS.values())[1:]))]
    return pa.RecordBatch.from_arrays(arrays + [v for v in more.values()], [*KINDS, *more])


def fingerprints(docs: DataFrame, scratch: Scratch, parts: int = 0) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how like the fingerprint is to the edited and the next one's.

    The next document is that of the next larger ``doc_id`` (nulls first, equal ids by their packed texts), after the
    last the first.  Likeness is the share of paragraphs two texts have in common.  Null texts are empty; two texts
    without paragraphs are alike (1).  An empty table gives no rows.  Texts are packed before the one shuffle; documents
    whose next one lies in the following partition are finished by a join of two rows a partition.
    """
    docs = texts(docs)
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            part = np.searchsorted(cuts, [-np.inf if i is None else i for i in ids], "left")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column("doc_id"),
                                              pa.array([packer.compress((t.as_py() or "").encode()) for t in batch.column("text")], pa.binary())],
                                             ["part", "doc_id", "packed"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        waiting: list[tuple] = []  # (part, doc_id, packed, text)
        size = 0

        def row(kind, part, doc_id, packed):
            return _batch([doc_id], [(None,) * 6], kind=pa.array([kind], pa.int32()), part=pa.array([part], pa.int32()), packed=pa.array([packed], pa.binary()))

        def done():
            own = [w for w, v in zip(waiting, waiting[1:]) if w[0] == v[0]]
            if own:
                rows = compare_block([w[3] for w in own], [v[3] for w, v in zip(waiting, waiting[1:]) if w[0] == v[0]])
                n = len(own)
                yield _batch([w[1] for w in own], rows, kind=pa.array([0] * n, pa.int32()), part=pa.array([w[0] for w in own], pa.int32()), packed=pa.array([None] * n, pa.binary()))

        last = None
        for batch in batches:
            for part, doc_id, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "packed"))):
                if last is None or last[0] != part:
                    if last is not None:
                        yield row(2, *last)
                    yield row(1, part, doc_id, packed)
                text = reader.decompress(packed).decode()
                waiting.append((part, doc_id, packed, text))
                last = (part, doc_id, packed)
                size += len(text)
                if size > BLOCK_CHARS and len(waiting) > 1:
                    yield from done()
                    waiting, size = waiting[-1:], len(text)
        yield from done()
        if last is not None:
            yield row(2, *last)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc_id, packed, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "following"))):
                yield _batch([doc_id], compare_block([reader.decompress(packed).decode()], [reader.decompress(following).decode()]))

    ordered = (docs.mapInArrow(pack, "part int, doc_id long, packed binary").repartitionById(len(cuts) + 1, F.col("part"))
               .sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "packed"))
    found = scratch.write(ordered.mapInArrow(compare, RESULT + ", kind int, part int, packed binary"))
    present = sorted(r.part for r in found.where("kind = 1").select("part").collect())  # at most the number of partitions
    following = docs.sparkSession.createDataFrame(list(zip(present, present[1:] + present[:1])), "part int, next_part int")
    heads = found.where("kind = 1").select(F.col("part").alias("next_part"), F.col("packed").alias("following"))
    ends = found.where("kind = 2").select("part", "doc_id", "packed").join(following, "part").join(heads, "next_part")
    return found.where("kind = 0").select(*KINDS).unionAll(ends.select("doc_id", "packed", "following").mapInArrow(finish, RESULT))
