"""Repair of conversation structure at the least cost, by the Four-Russians method.

A sound conversation is empty, or a system row if any, then user and assistant rows in turns.  The rows of a conversation
are edited (kept, given another role, deleted, inserted between) so that it becomes sound at the least cost.

What the rest of a conversation costs depends only on where the output stands: at its start, or after a system, user
or assistant row.  So every row turns a vector of four costs into another one.  The differences within a vector are
bounded, hence there are few vectors up to a constant, and all are found in advance, with the transition of each
for every symbol a row can be.  Transitions are then put together for every block of ``BLOCK`` symbols: a conversation
is read from its end, one lookup for a block.  The vectors kept between blocks are enough to expand a block backward, row
by row, when the edits are traced from the front: at each place the first letter that loses nothing is taken, so among
equally cheap edits the ASCII-least sequence comes out, whatever the blocks are.  Expansions are remembered as well.

Conversations are read as sorted streams: once without texts for the edits (one byte a row is held), and once to apply
them.  No conversation's texts are gathered in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell.llm.common import Scratch, cut

REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
BLOCK = 4
#: Where the output stands: nothing yet, or the last row's role.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or reroled row leads, and the role it has; where a kept row of each initial leads, if it may stand there.
ONWARD, ONWARD_ROLE = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
INITIALS = "sua"
KEPT = ((SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None), (None, None, None, None))
#: What is left to pay at the end of the rows.
END = (0, 2 * INSERT, INSERT, 0)
#: Symbols: no row, a row that has to go, and 2 + 2 * initial + unfinished for the others.
NO_ROW, MUST_GO, SYMBOLS = 0, 1, 10
#: White space of a blank row.
BLANK = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")


def before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs from in front of a row on, given those from behind it on."""
    if symbol == NO_ROW:
        return after
    costs = [DELETE + c for c in after]
    if symbol != MUST_GO:
        initial, unfinished = divmod(symbol - 2, 2)
        for at in range(4):
            costs[at] = min(costs[at], REROLE + UNFINISHED * unfinished + after[ONWARD[at]])
            if (to := KEPT[initial][at]) is not None:
                costs[at] = min(costs[at], UNFINISHED * unfinished + after[to])
    user, assistant = min(costs[USER], INSERT + costs[ASSISTANT]), min(costs[ASSISTANT], INSERT + costs[USER])
    return min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant


class Tables:
    """All cost vectors up to a constant, and where each leads, at which cost, for every symbol and block of symbols."""

    def __init__(self, block: int = BLOCK):
        self.block, self.vectors, number = block, [END], {END: 0}
        steps: list[list[tuple[int, int]]] = []
        for vector in self.vectors:  # grows while new vectors turn up
            steps.append([])
            for symbol in range(SYMBOLS):
                costs = before(vector, symbol)
                least = min(costs)
                plain = tuple(c - least for c in costs)
                if plain not in number:
                    number[plain] = len(self.vectors)
                    self.vectors.append(plain)
                steps[-1].append((number[plain], least))
        self.steps = steps
        one = np.array(steps, np.int64)
        to, cost = one[:, :, 0], one[:, :, 1]
        for _ in range(block - 1):  # a symbol in front of every shorter block
            cost = (cost[:, :, None] + one[to][:, :, :, 1]).swapaxes(1, 2).reshape(len(one), -1)
            to = one[to][:, :, :, 0].swapaxes(1, 2).reshape(len(one), -1)
        self.to, self.cost = to.tolist(), cost.tolist()
        self.powers = SYMBOLS ** np.arange(block - 1, -1, -1)
        self.expanded = lru_cache(200_000)(self.expand)

    def plan(self, symbols: np.ndarray) -> tuple[int, str]:
        """Least cost and ASCII-least edits of a conversation: D(elete), I(nsert), K(eep) and R(erole) in order."""
        padded = np.concatenate([np.zeros(-len(symbols) % self.block, np.int64), symbols.astype(np.int64)])
        codes = (padded.reshape(-1, self.block) @ self.powers).tolist()
        vector, paid, behind = 0, 0, []
        for code in reversed(codes):
            behind.append(vector)
            paid += self.cost[vector][code]
            vector = self.to[vector][code]
        at, edits, total = START, [], paid + self.vectors[vector][START]
        for code, vector in zip(codes, reversed(behind)):
            letters, at = self.expanded(vector, code, at)
            edits.append(letters)
        return total, "".join(edits) + {SYSTEM: "II", USER: "I"}.get(at, "")

    def expand(self, behind: int, code: int, at: int) -> tuple[str, int]:
        """Edits of a block of symbols from state ``at`` on, and the state after it; ``behind``: the vector behind it."""
        symbols = [code // int(p) % SYMBOLS for p in self.powers]
        costs = [self.vectors[behind]]
        for symbol in reversed(symbols):
            costs.append(before(costs[-1], symbol))
        costs.reverse()
        letters = []
        for symbol, here, after in zip(symbols, costs, costs[1:]):
            while symbol != NO_ROW:
                initial, unfinished = divmod(symbol - 2, 2) if symbol != MUST_GO else (3, 0)
                kept = KEPT[initial][at]
                if here[at] == DELETE + after[at]:
                    letters.append("D")
                    break
                if here[at] == INSERT + here[ONWARD[at]]:
                    letters.append("I")
                    at = ONWARD[at]
                    continue
                if kept is not None and here[at] == UNFINISHED * unfinished + after[kept]:
                    letters.append("K")
                    at = kept
                    break
                letters.append("R")
                at = ONWARD[at]
                break
        return "".join(letters), at


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with seeded faults, by crc32 of ``conv_id:turn`` modulo 20; ``gone`` marks dropped rows.

    0 drops the row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it at the same turn, 4 makes it a user's.
    Null role and text, and null parts of the key, read as one space.
    """
    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    return (rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind"))
            .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
            .withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
            .withColumn("copy", F.explode(F.expr("sequence(0, if(kind = 3, 1, 0))")))
            .select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone")))


def marked(rows: DataFrame) -> DataFrame:
    """Rows with their place ``pos`` in the conversation (from 1), first ``fault``, ``initial`` and ``symbol``.

    The order is by turn (nulls first), then role and text; null role and text read as one space.  ``gone`` rows come
    last; they only tell that the conversation exists.
    """
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], "gone")
    place = Window.partitionBy("conv_id").orderBy("gone", F.asc_nulls_first("turn"), "role", "text")
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("pos")
    last = F.expr("right(rtrim(' \\t\\n\\u000b\\f\\r', text), 1)")
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    return (rows.repartition("conv_id").withColumn("pos", F.row_number().over(place).cast("long"))
            .withColumn("repeated", F.row_number().over(same) > 1).withColumn("last", last)
            .withColumn("fault", F.when(F.col("last") == "", 1).when(F.col("repeated"), 2).when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0))
            .withColumn("initial", F.when((F.substring("role", 1, 1) == "") | (initial < 0), 3).otherwise(initial))
            .withColumn("symbol", F.when(F.col("gone"), NO_ROW).when(F.col("fault").isin(1, 2), MUST_GO)
                        .otherwise(2 + 2 * F.col("initial") + (F.col("fault") == 3).cast("int")))
            .select("conv_id", "pos", "turn", "role", "text", "gone", *[F.col(c).cast("int").alias(c) for c in ("fault", "initial", "symbol")]))


def _streams(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, bool, pa.RecordBatch]]:
    """Slices of sorted batches, each of one conversation: its id, whether it begins here, and the rows."""
    open_id: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        null = batch.column("conv_id").is_null().to_numpy(zero_copy_only=False)
        ids = batch.column("conv_id").fill_null(0).to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.flatnonzero((ids[1:] != ids[:-1]) | (null[1:] != null[:-1])) + 1, len(ids)].tolist()
        for start, end in zip(starts, starts[1:]):
            own = (None if null[start] else int(ids[start]),)
            yield own[0], own != open_id, batch.slice(start, end - start)
            open_id = own


class _Reading:
    """What is known of a conversation while its rows go by."""

    def __init__(self):
        self.symbols, self.faults = bytearray(), np.zeros(4, np.int64)
        self.first = self.last_turn = self.last_initial = None
        self.turns = self.illegal = 0

    def add(self, rows: pa.RecordBatch) -> None:
        here = ~rows.column("gone").to_numpy(zero_copy_only=False)
        if not here.any():
            return
        symbol, fault, initial = (rows.column(c).to_numpy(zero_copy_only=False)[here] for c in ("symbol", "fault", "initial"))
        self.symbols += symbol.astype(np.uint8).tobytes()
        self.faults += np.bincount(fault, minlength=4)
        pairs = initial if self.last_initial is None else np.r_[self.last_initial, initial]
        self.illegal += int((~np.isin(pairs[:-1] * 4 + pairs[1:], (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))).sum())
        self.last_initial = initial[-1]
        turns = rows.column("turn").filter(pa.array(here)).drop_null().to_numpy(zero_copy_only=False)
        if len(turns):
            self.turns += int((np.diff(turns) != 0).sum()) + (self.last_turn is None or int(turns[0]) != self.last_turn)
            self.first = int(turns[0]) if self.first is None else self.first
            self.last_turn = int(turns[-1])

    def report(self, tables: Tables) -> tuple:
        cost, audit = tables.plan(np.frombuffer(self.symbols, np.uint8))
        gaps = 0 if self.first is None else self.last_turn - self.first + 1 - self.turns
        return gaps, *self.faults[1:].tolist(), self.illegal, cost, audit


COUNTS = ("gaps", *FAULTS, "illegal", "cost")
REPORT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"


def plans(rows: DataFrame) -> DataFrame:
    """``conv_id``, gaps of the turns, faults, illegal neighbours, least cost and edits of each conversation of ``marked`` rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, out, reading, own = Tables(), [], None, None

        def packed() -> pa.RecordBatch:
            ids, *counts, audits = zip(*out)
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (ids, *counts)), pa.array(audits, pa.string())], ["conv_id", *COUNTS, "audit"])

        for conv_id, new, part in _streams(batches):
            if new:
                if reading:
                    out.append((own, *reading.report(tables)))
                reading, own = _Reading(), conv_id
                if len(out) == 5000:
                    yield packed()
                    out = []
            reading.add(part)
        if reading:
            out.append((own, *reading.report(tables)))
            yield packed()

    return (rows.select("conv_id", "pos", "turn", "gone", "fault", "initial", "symbol").repartition("conv_id")
            .sortWithinPartitions("conv_id", "pos").drop("pos").mapInArrow(run, REPORT))


def _edited(part: pa.RecordBatch, state: list) -> Iterator[tuple[str, str]]:
    """Roles and texts that the edits make of the next rows; ``state``: the edits, how many are done, where the output stands."""
    for role, text in zip(part.column("role").to_pylist(), part.column("text")):
        if role is None:  # the row with the edits
            continue
        while state[0][state[1]] == "I":
            yield from _inserted(state)
        letter = state[0][state[1]]
        state[1] += 1
        if letter == "K":
            state[2] = 1 + INITIALS.index(role[0])
            yield role, text.as_py()
        elif letter == "R":
            role, state[2] = ONWARD_ROLE[state[2]], ONWARD[state[2]]
            yield role, text.as_py()


def _inserted(state: list) -> Iterator[tuple[str, str]]:
    role, state[2] = ONWARD_ROLE[state[2]], ONWARD[state[2]]
    state[1] += 1
    yield role, ""


def _applied(rows: DataFrame, reports: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over each partition's conversations in order: the row with the edits first, then the rows they are for."""
    stream = rows.where("not gone").select("conv_id", "pos", "role", "text").unionByName(reports.withColumn("pos", F.lit(0).cast("long")), allowMissingColumns=True)
    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, schema)


def repaired_rows(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations of ``marked`` rows, places from 1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, state, own, place = [], None, None, 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["conv_id", "place", "role", "text"])

        def rest() -> Iterator[tuple[str, str]]:
            while state and state[1] < len(state[0]):
                yield from _inserted(state)

        for conv_id, new, part in _streams(batches):
            if new:
                for role, text in rest():
                    place += 1
                    out.append((own, place, role, text))
                state, own, place = [part.column("audit")[0].as_py(), 0, START], conv_id, 0
            for role, text in _edited(part, state):
                place += 1
                out.append((own, place, role, text))
            if len(out) >= 5000:
                yield packed()
                out.clear()
        for role, text in rest():
            place += 1
            out.append((own, place, role, text))
        if out:
            yield packed()

    return _applied(rows, reports.select("conv_id", "audit"), run, "conv_id long, place long, role string, text string")


def repair_report(rows: DataFrame) -> DataFrame:
    """One row for each conversation: ``conv_id``, the counts of COUNTS, ``audit`` and ``repaired_sha256``.

    ``rows`` has conv_id, turn, role, text and ``gone`` (as ``damaged`` gives it); other columns are not read.  A row's
    first fault counts: blank, a duplicate of an earlier row, or truncated.  Blank rows and duplicates have to go.
    ``illegal`` counts neighbours whose initials are not su, ua or au; ``gaps`` the turns missing between the least and
    the greatest (null turns stand first and are not counted).  Null conv_ids are one conversation.  Rows that tie in
    turn, role and text are duplicates; a conversation without rows has zeros, no edits and the digest of the empty
    string; texts of any length are hashed as they stream by.  An empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "structure")
    rows = scratch.write(marked(rows))
    reports = scratch.write(plans(rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, row, digest, any_row, out = None, None, None, False, []

        def say(role: str, text: str) -> None:
            nonlocal any_row
            digest.update((("\n" if any_row else "") + f"{role}:{text}").encode())
            any_row = True

        def closed() -> dict:
            while state[1] < len(state[0]):
                for role, text in _inserted(state):
                    say(role, text)
            return row | {"repaired_sha256": digest.hexdigest()}

        for _, new, part in _streams(batches):
            if new:
                if state:
                    out.append(closed())
                    if len(out) == 5000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                row = part.slice(0, 1).select(["conv_id", *COUNTS, "audit"]).to_pylist()[0]
                state, digest, any_row = [row["audit"], 0, START], hashlib.sha256(), False
            for role, text in _edited(part, state):
                say(role, text)
        if state:
            out.append(closed())
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    out = cut(_applied(rows, reports, run, REPORT + ", repaired_sha256 string"))
    scratch.close()
    return out
