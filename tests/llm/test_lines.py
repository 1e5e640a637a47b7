"""Line dedup against a brute-force version: every document, every line, whatever the batches."""

import hashlib
from collections import defaultdict

import pytest

from ratewell.llm import lines

LONG = "This sentence is long enough to be a key of its own."
UMLAUT = "ä" * 39
ROWS = [(i, f"{LONG}\nown line of document {i} that nobody else in the corpus has") for i in range(4)]
ROWS += [(10, f"  {LONG.upper()}\t\nshort"), (11, "short\nshort\nshort"), (12, ""), (13, None), (None, LONG), (14, "\n\n"),
         (15, LONG + "\n" + LONG), (20, UMLAUT), (21, UMLAUT), (22, UMLAUT), (23, UMLAUT), (24, UMLAUT + "\n" + UMLAUT + "ä"),
         (25, UMLAUT + "Ä"), (30, "y" * 200_000 + "\n" + LONG), (31, LONG), (31, LONG)]
ROWS += [(40 + i, UMLAUT + "ä\r") for i in range(5)]
ROWS += [(9, f"{LONG}\n{UMLAUT}ä\nstays")]  # loses two keys


def brute(rows, least_chars=40, least_docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if i is None or len(holders[key(x)]) < least_docs or len(key(x)) < least_chars or max(holders[key(x)]) == i]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


@pytest.mark.parametrize("limits", [{}, {"batches": 1}, {"batches": 7, "fanout": 2}])
def test_report(frame, limits):
    got = [tuple(r) for r in lines.line_report(frame(ROWS), **limits).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted([r[:4] for r in brute(ROWS)], key=str)
    assert sum(r[2] for r in got) > 5


def test_stage_keeps_rows_and_columns(frame):
    docs = frame(ROWS)
    out = lines.dedup_lines(docs)
    assert out.dtypes == docs.dtypes
    want = sorted(((i, None if t is None else b[4]) for (i, t), b in zip(ROWS, brute(ROWS))), key=str)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == want
    assert all(r.n_chars == len(r.text or "") and r.key == "x" for r in out.collect())


def test_no_rows(frame):
    assert lines.line_report(frame(ROWS).limit(0)).count() == 0
    assert lines.line_report(frame([(1, None), (2, "a")])).count() == 2
