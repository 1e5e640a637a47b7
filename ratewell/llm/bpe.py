"""Byte-level BPE by merge replay.

A block of documents is a corpus of its own: its distinct words are laid out one after another, an inverted
index leads from each mergeable token pair to the word positions where it stands, and the merges are applied to
the whole corpus in rank order, each touching only the neighbours of the merged places.  Words seen before in
the same worker are remembered (bounded), so frequent words are replayed once.

Blocks need no shuffle and no state outside the task: a lost executor repeats its blocks, and the work of a
block is proportional to its text.  A shuffle of the corpus-wide word list was left out on purpose, because
bringing the ids back to the places of the words would move every occurrence of every word.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ratewell.llm.common import text_blocks, texts

#: White space other than blanks and line ends, in any library's reading.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
BLOCK_CHARS = 8_000_000
#: Bytes of words and their ids in a generation of what a worker remembers; what an entry takes besides them.
CACHE_BYTES, ENTRY_BYTES = 64_000_000, 250
NEVER = np.int32(2**31 - 1)
NOWHERE = np.empty(0, np.int32)
#: Pairs that are looked up at a time.
LOOKUP = 1 << 16


class Vocabulary:
    """Ranks of a byte-level BPE: token bytes by id, and the rank of every pair of tokens that merges."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines()) if token}
        self.size = max(self.ranks.values()) + 1
        self.token = [b""] * self.size
        for token, rank in self.ranks.items():
            self.token[rank] = token
        # every way to cut a token into two tokens: two neighbours merge exactly if their bytes are a token
        pairs = {self.ranks[t[:k]] * self.size + self.ranks[t[k:]]: rank for t, rank in self.ranks.items()
                 for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        self.pair = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair.tolist()], np.int32)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NEVER`` where the two don't merge."""
        if len(left) > LOOKUP:  # keys and places take eight times what the ranks do
            parts = [slice(a, a + LOOKUP) for a in range(0, len(left), LOOKUP)]
            return np.concatenate([self.merged(left[p], right[p]) for p in parts])
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        return np.where(self.pair[at] == key, self.pair_rank[at], NEVER)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word after all merges, lowest rank first, leftmost first among equals.

        ``places`` is the inverted index: rank of a pair -> positions of its left token, some of them outdated; ``added``
        holds those that merges make.  A position takes about 46 bytes, the words of a block lie in memory all at once.
        """
        length = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(length) - length
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        before[starts[length > 0]] = -1
        after[(starts + length - 1)[length > 0]] = -1
        rank_at = np.full(n, NEVER, np.int32)  # of the pair that a position and the next one make
        rank_at[:-1] = np.where(after[:-1] >= 0, self.merged(sym[:-1], sym[1:]), NEVER)
        alive = np.ones(n, bool)
        order = np.flatnonzero(rank_at < NEVER).astype(np.int32)
        order = order[np.argsort(rank_at[order], kind="stable")]
        ranks, at = np.unique(rank_at[order], return_index=True)
        places = dict(zip(ranks.tolist(), np.split(order, at[1:])))
        added: dict[int, list[int]] = {}
        queue = list(places)
        heapify(queue)
        while queue:
            rank = heappop(queue)
            p = np.concatenate([places.pop(rank, NOWHERE), np.array(added.pop(rank, ()), np.int32)])
            p = np.unique(p[rank_at[p] == rank])
            if not len(p):
                continue
            q = after[p]
            if (p[1:] == q[:-1]).any():  # "aaa": the leftmost goes first, the place it takes part in is gone
                free, taken = [], -1
                for x, y in zip(p.tolist(), q.tolist()):
                    if x != taken:
                        free.append(x)
                        taken = y
                p = np.array(free, np.int32)
                q = after[p]
            left, right = before[p], after[q]
            if ((left >= 0) & (self.merged(sym[left], np.full(len(p), rank)) < rank)
                    | (right >= 0) & (self.merged(np.full(len(p), rank), sym[right]) < rank)).any():
                # a merge makes a pair that goes before this rank: one place a word now, the others afterwards
                first = np.unique(np.searchsorted(starts, p, "right"), return_index=True)[1]
                if len(first) < len(p):
                    places[rank] = np.delete(p, first)
                    heappush(queue, rank)
                    p = p[first]
                    q = after[p]
                    right = after[q]
            sym[p] = rank
            alive[q] = False
            rank_at[q] = NEVER
            after[p] = right
            before[right[right >= 0]] = p[right >= 0]
            left = before[p]
            own = np.where(right >= 0, self.merged(sym[p], sym[right]), NEVER)
            rank_at[p] = own
            touched, left = p[own < NEVER].tolist(), left[left >= 0]
            new = own[own < NEVER].tolist()
            own = self.merged(sym[left], sym[after[left]])
            rank_at[left] = own
            touched += left[own < NEVER].tolist()
            new += own[own < NEVER].tolist()
            for place, r in zip(touched, new):
                if r in added:
                    added[r].append(place)
                else:
                    added[r] = [place]
                    if r not in places:
                        heappush(queue, r)
        kept = np.cumsum(alive)
        ends = np.where(length > 0, kept[np.maximum(starts + length - 1, 0)] if n else 0, 0).tolist()
        packed, out, a = sym[alive].astype("<u4").tobytes(), [], 0
        for end, size in zip(ends, length.tolist()):
            if size:
                out.append(packed[4 * a:4 * end])
                a = end
            else:
                out.append(b"")
        return out


def plain(text: str) -> bool:
    """Only single blanks and line ends between words?  Other texts take the general path."""
    return not (not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text
                or "\n " in text or OTHER_SPACE.search(text))


class Encoder:
    """Texts to ids and back, with the words met so far remembered as packed ids."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.vocabulary = Vocabulary(rank_file)
        self.pattern = regex.compile(pattern)
        probe = " été. Año, été, año"
        self.by_letters = self.pattern.findall(probe) == [" été", ".", " Año", ",", " été", ",", " año"]
        self.piece: dict[str, bytes] = {}   # one match of the pattern -> packed ids
        self.first: dict[str, bytes] = {}   # a run between blanks at the start of a line
        self.later: dict[str, bytes] = {}   # a run that follows a blank: its first match takes the blank
        self.older: tuple[dict[str, bytes], ...] = ({}, {}, {})
        self.held = 0

    def forget(self) -> None:
        """Both generations of words go; what a worker remembers would lie beside the memory of later stages."""
        self._age()
        self._age()

    def _age(self) -> None:
        """Words not met since the last time go; those of the present generation go next time unless they are met again."""
        self.older = self.piece, self.first, self.later
        self.piece, self.first, self.later, self.held = {}, {}, {}, 0

    def _missing(self, kind: dict[str, bytes], old: dict[str, bytes], words: set[str]) -> list[str]:
        """Words that neither generation knows; those of the older one move up."""
        found = [w for w in words if w not in kind]
        known = [w for w in found if w in old]
        self._keep(kind, known, map(old.__getitem__, known))
        return [w for w in found if w not in kind] if known else found

    def _keep(self, kind: dict[str, bytes], words: Iterable[str], ids: Iterable[bytes]) -> None:
        for word, packed in zip(words, ids):
            kind[word] = packed
            self.held += ENTRY_BYTES + len(word) + len(packed)

    def _cut(self, run: str, blank: str = "") -> list[str] | tuple[str, ...]:
        """Matches of the pattern in a run between blanks; of letters and a stop there is no need to search."""
        if self.by_letters:
            if run.isalpha():
                return (blank + run,)
            if run[-1] in ".," and run[:-1].isalpha():
                return blank + run[:-1], run[-1]
        return self.pattern.findall(blank + run)

    def _learn(self, pieces: set[str]) -> None:
        new = self._missing(self.piece, self.older[0], pieces)
        self._keep(self.piece, new, self.vocabulary.replay([w.encode() for w in new]))

    def encode(self, found: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, each match of the pattern encoded by itself."""
        if self.held > CACHE_BYTES:
            self._age()
        simple_texts = [plain(t) for t in found]
        first, later, pieces = set(), set(), {"\n"}
        for text, simple in zip(found, simple_texts):
            if simple:
                for line in text.split("\n"):
                    runs = line.split(" ")
                    first.add(runs[0])
                    later.update(runs[1:])
            else:
                pieces.update(self.pattern.findall(text))
        first, later = self._missing(self.first, self.older[1], first), self._missing(self.later, self.older[2], later)
        for run in first:
            pieces.update(self._cut(run))
        for run in later:
            pieces.update(self._cut(run, " "))
        self._learn(pieces)
        del pieces
        piece = self.piece.__getitem__
        self._keep(self.first, first, (b"".join(map(piece, self._cut(run))) for run in first))
        self._keep(self.later, later, (b"".join(map(piece, self._cut(run, " "))) for run in later))
        end, first_ids, later_ids, out = piece("\n"), self.first, self.later.__getitem__, []
        for text, simple in zip(found, simple_texts):
            if simple:
                lines = []
                for line in text.split("\n"):
                    runs = line.split(" ")
                    lines.append(first_ids[runs[0]] + b"".join(map(later_ids, runs[1:])))
                out.append(end.join(lines))
            else:
                out.append(b"".join(map(piece, self.pattern.findall(text))))
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(rank_file: bytes, pattern: str) -> Encoder:
    """One encoder a worker process: building the pair table takes half a second."""
    key = (hashlib.sha256(rank_file).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(rank_file, pattern)
    return _ENCODERS[key]


def _rank_file(spark, path: str):
    """The rank file, read once and sent to the workers: its size is that of the vocabulary, not of the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every whole text.

    A null text is empty and has no ids; a null ``doc_id`` is passed through; repeated rows are encoded each;
    columns other than ``doc_id`` and ``text`` are not read.
    """
    ranks = _rank_file(docs.sparkSession, rank_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in text_blocks(batches, BLOCK_CHARS):
            packed = encoder(ranks.value, pattern).encode(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()),
                                              pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in packed],
                                                       pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def encoding_digests(docs: DataFrame, rank_path: str, pattern: str, block_chars: int = BLOCK_CHARS, remember: bool = True) -> DataFrame:
    """Per document: number of ids, digest of the ids as written to disk, digest of the bytes decoded from them.

    Encodes as ``encode_documents`` does and decodes the ids again in the same task, so no ids are shuffled.
    Empty and null texts have 0 ids and the digest of no bytes; an empty table gives an empty result.  Unless told
    to ``remember`` words for its next task, a worker gives their memory back.
    """
    ranks = _rank_file(docs.sparkSession, rank_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in text_blocks(batches, block_chars):
            coder = encoder(ranks.value, pattern)
            counts, packed_hex, text_hex = [], [], []
            for packed in coder.encode(found):
                counts.append(len(packed) // 4)
                packed_hex.append(hashlib.sha256(packed).hexdigest())
                text_hex.append(hashlib.sha256(coder.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(packed_hex, pa.string()),
                 pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        if not remember:
            encoder(ranks.value, pattern).forget()
            pa.default_memory_pool().release_unused()

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, rank_path: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows of ids; null ids give a null text, bytes that are no UTF-8 are replaced."""
    ranks = _rank_file(encoded.sparkSession, rank_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = encoder(ranks.value, r"\p{L}+")
            found = [None if x is None else b"".join(map(coder.vocabulary.token.__getitem__, x)).decode(errors="replace")
                     for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids").mapInArrow(run, "doc_id long, text string")
