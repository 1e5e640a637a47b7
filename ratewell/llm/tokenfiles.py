"""Token ids in directly addressable files.

Ids are cut into chunks of 8 bits.  Level 0 holds the lowest chunk of every id; a continuation bitmap says which ids
have more, and the next level holds their next chunk, and so on.  A rank directory (ones before every 512 bits)
leads from the place of an id in one level to its place in the next, so any id is read without decoding others.

A file row is a segment: a run of documents in ascending ``doc_id`` with their offsets.  Segments are Parquet rows,
so they are written and read through Spark on any store; none holds more than ``SEGMENT_IDS`` ids besides one document.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratewell.llm.common import Scratch, bounded_broadcast, text_blocks, texts

CHUNK, DIRECTORY = 8, 512
SEGMENT_IDS = 2_000_000
BLOCK_CHARS = 4_000_000
CACHE_WORDS = 1_000_000
POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)
LEVELS = "array<struct<chunks: binary, more: binary, ranks: binary>>"
SEGMENT = f"part int, seq int, first_id long, doc_ids array<long>, offsets array<long>, n long, levels {LEVELS}"


def pack(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of an array of ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(CHUNK) > 0
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(bits) // (DIRECTORY // 8)) * (DIRECTORY // 8), np.uint8)
        padded[:len(bits)] = bits
        ones = POPCOUNT[padded].reshape(-1, DIRECTORY // 8).sum(axis=1, dtype=np.int64)
        levels.append({"chunks": (rest & np.uint32(255)).astype(np.uint8).tobytes(), "more": bits.tobytes(),
                       "ranks": (np.cumsum(ones) - ones).astype("<u8").tobytes()})
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(CHUNK)


class Segment:
    """Reads ids at any places of packed levels."""

    def __init__(self, levels: list[dict[str, bytes]]):
        self.levels = [(np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["ranks"], "<u8").astype(np.int64)) for x in levels]

    def at(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.uint32)
        who, at = np.arange(len(places)), np.asarray(places, np.int64)
        for depth, (chunks, more, ranks) in enumerate(self.levels):
            out[who] |= chunks[at].astype(np.uint32) << np.uint32(CHUNK * depth)
            go = (more[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            who, at = who[go], at[go]
            if not len(at):
                break
            # ones before a bit: the directory's count, whole bytes since, and the bits of its own byte
            ones = np.concatenate([[0], np.cumsum(POPCOUNT[more], dtype=np.int64)]) if len(at) > len(more) // 64 else None
            byte = at >> 3
            if ones is None:
                since = np.array([int(POPCOUNT[more[b // 64 * 64:b]].sum()) for b in byte.tolist()], np.int64)
                before = ranks[at // DIRECTORY] + since
            else:
                before = ranks[at // DIRECTORY] + ones[byte] - ones[at // DIRECTORY * (DIRECTORY // 8)]
            at = before + POPCOUNT[more[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)]
        return out


#: Texts of which lower-casing and splitting are the same for every library: no control characters, no letters
#: beyond the Latin blocks, no composed forms to make.  Others go to the tokenizer as they are.
SIMPLE = re.compile("[\n\t\r -~¡-įı-ɏ]*\\Z")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class WordTokenizer:
    """A tokenizer whose normal form and word split work on each run between blanks by itself, runs remembered.

    The words of a tokenizer of this kind end in ids of tokens with a word-end suffix, so new words are encoded many
    at a time by the library and cut at those ids.  ``by_words`` says whether the tokenizer is of this kind; one
    of another kind gets whole texts.
    """

    def __init__(self, config: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task a core
        text = config.decode()
        self.library = Tokenizer.from_str(text)
        suffix = self.library.model.end_of_word_suffix if hasattr(self.library.model, "end_of_word_suffix") else None
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        probe = "It's Été 12 foo-bar, x"
        self.by_words = bool(suffix) and self._whole([probe])[0].tolist() == [i for w in PIECES.findall(probe.lower()) for i in self._whole([w])[0].tolist()]
        #: Ids of runs and words, in two generations: what is met again moves up, the rest goes with the old one.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, found: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(found, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        width = np.dtype(self.kind).itemsize
        for a in range(0, len(new), 256):
            part = new[a:a + 256]
            ids = self._whole([" ".join(part)])[0]
            ends = (np.flatnonzero(self.last[ids]) + 1) * width
            if len(ends) == len(part):
                packed, start = ids.astype(self.kind).tobytes(), 0
                for word, end in zip(part, ends.tolist()):
                    self.young[word] = packed[start:end]
                    start = end
            else:
                self.young.update((w, x.astype(self.kind).tobytes()) for w, x in zip(part, self._whole(part)))

    def _know(self, wanted: set[str], several: bool) -> dict[str, list[str] | tuple[str, ...]]:
        """Move up what the old generation has; of the rest the runs of several words, with their words."""
        new, cuts, old = [], {}, self.old.get
        for run in wanted:
            ids = old(run)
            if ids is not None:
                self.young[run] = ids
                continue
            cut = self._cut(run) if several else (run,)
            if len(cut) == 1 and cut[0] == run:
                new.append(run)
            else:
                cuts[run] = cut
        self._learn(new)
        return cuts

    @property
    def kind(self) -> str:
        """Width of an id in packed form."""
        return "<u2" if len(self.last) <= 1 << 16 else "<u4"

    def encode(self, found: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, self.kind).astype(np.uint32) for x in self.packed(found)]

    def packed(self, found: list[str]) -> list[bytes]:
        """Packed ids of each text.  Texts of which all runs are known are looked up at once, the others after learning."""
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        out, waiting, unknown, get = [], [], set(), self.young.get
        for place, text in enumerate(found):
            if not self.by_words or SIMPLE.match(text) is None or any(s in text for s in self.special):
                out.append(self._whole([text])[0].astype(self.kind).tobytes())
                continue
            runs = text.lower().split()
            parts = list(map(get, runs))
            if None in parts:
                unknown.update(run for run, part in zip(runs, parts) if part is None)
                waiting.append((place, runs))
                out.append(b"")
            else:
                out.append(b"".join(parts))
        cuts = self._know(unknown, True)
        self._know({w for cut in cuts.values() for w in cut if w not in self.young}, False)
        for run, cut in cuts.items():
            self.young[run] = b"".join(map(self.young.__getitem__, cut))
        for place, runs in waiting:
            out[place] = b"".join(map(get, runs))
        return out

    @staticmethod
    def _cut(run: str) -> list[str] | tuple[str, ...]:
        if run.isalpha():
            return (run,)
        if run[-1] in ".," and run[:-1].isalpha():
            return run[:-1], run[-1]
        return PIECES.findall(run)


_TOKENIZERS: dict[bytes, WordTokenizer] = {}


def _tokenizer(config: bytes) -> WordTokenizer:
    """One a worker process: reading the vocabulary takes a moment."""
    if config not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[config] = WordTokenizer(config)
    return _TOKENIZERS[config]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, scratch: Scratch, parts: int = 0) -> DataFrame:
    """Write every whole text's ids with ``end_id`` behind, in ascending ``doc_id``, and return the written segments.

    Null ids of documents come first; rows of one ``doc_id`` are documents of their own, in order of their ids'
    bytes; a null text is empty.  Ranges of ``doc_id`` are cut at quantiles of the ids alone, so texts are encoded once and only
    packed ids are shuffled.  An empty table gives no segments.
    """
    with open(tokenizer_path, "rb") as f:
        config = docs.sparkSession.sparkContext.broadcast(f.read())  # of the vocabulary's size
    docs, wide = texts(docs), end_id >= 1 << 16
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in text_blocks(batches, BLOCK_CHARS):
            tokenizer = _tokenizer(config.value)
            packed = tokenizer.packed(found)
            if wide and tokenizer.kind == "<u2":
                packed = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in packed]
            width = 4 if wide else np.dtype(tokenizer.kind).itemsize
            end = end_id.to_bytes(width, "little")
            part = np.searchsorted(cuts, [-np.inf if i is None else i for i in ids], "left")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(ids, pa.int64()), pa.array([len(x) // width + 1 for x in packed], pa.int64()),
                                              pa.array([x + end for x in packed], pa.binary())], ["part", "doc_id", "n", "ids"])

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, arrays, size, part, seq = [], [], 0, None, 0

        def row():
            offsets = np.cumsum([0] + [len(x) for x in arrays])
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "first_id": ids[0], "doc_ids": ids, "offsets": offsets.tolist(), "n": int(offsets[-1]),
                                                "levels": pack(np.concatenate(arrays))}], schema)

        for batch in batches:
            for p, doc_id, n, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "ids"))):
                if ids and (p != part or size + n > SEGMENT_IDS):
                    yield row()
                    ids, arrays, size, seq = [], [], 0, seq + 1 if p == part else 0
                part = p
                ids.append(doc_id)
                arrays.append(np.frombuffer(packed, "<u2" if len(packed) == 2 * n else "<u4").astype(np.uint32))
                size += n
        if ids:
            yield row()

    level = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("offsets", pa.list_(pa.int64())), ("n", pa.int64()), ("levels", pa.list_(level))])
    ranged = (docs.mapInArrow(encode, "part int, doc_id long, n long, ids binary").repartitionById(max(1, len(cuts) + 1), F.col("part"))
              .sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids"))
    return scratch.write(ranged.mapInArrow(segments, SEGMENT))


def token_index(files: DataFrame) -> DataFrame:
    """(part, seq, base): ids in the segments before; a row a segment, so its window is over a short list."""
    counts = files.select("part", "seq", "n").collect()  # three numbers a segment of 2 million ids
    rows, base = [], 0
    for row in sorted(counts, key=lambda r: (r.part, r.seq)):
        rows.append((row.part, row.seq, base))
        base += row.n
    return files.sparkSession.createDataFrame(rows, "part int, seq int, base long")


def read_documents(files: DataFrame) -> DataFrame:
    """Per document of written segments: ``doc_id``, ``start``, ``n_tokens`` and the crc32 of its ids, read one by one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, offsets, levels, base = (batch.column(c)[row].as_py() for c in ("doc_ids", "offsets", "levels", "base"))
                segment = Segment(levels)
                sums = []
                step = 1024  # documents whose places are looked up together
                for a in range(0, len(doc_ids), step):
                    b = min(a + step, len(doc_ids))
                    ids = segment.at(np.arange(offsets[a], offsets[b])).astype("<u4")
                    sums += [zlib.crc32(ids[offsets[k] - offsets[a]:offsets[k + 1] - offsets[a]].tobytes()) for k in range(a, b)]
                at = np.array(offsets, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(sums, pa.int64())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    return (files.join(bounded_broadcast(token_index(files)), ["part", "seq"])
            .select("doc_ids", "offsets", "levels", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))
