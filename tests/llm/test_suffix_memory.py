"""Fragments and shards of the suffix stage need memory for what differs, not for every copy."""

import numpy as np
import pyarrow as pa
import pytest

from panelloom.llm import suffix

from conftest import prose

LINE = "a line of well over fifty bytes that very many of the documents have in them"


def judged(texts, blocks=3):
    """Spans found by the tasks, all in one fragment and one shard: a set of (doc, byte)."""
    docs = pa.table({"doc_id": pa.array([i for i, _ in texts], pa.int64()), "text": pa.array([t.encode() for _, t in texts], pa.binary())})
    dealt = pa.Table.from_batches(suffix.run_task(1, 50, 16)(iter(docs.to_batches())))
    spans = suffix.fragment_task(1, blocks, 50)((pa.scalar(0),), dealt)
    compared = spans.filter(pa.compute.greater_equal(spans.column("group"), 0))
    texts_of = suffix.fetch_task(1)((0,), docs, compared)
    found = suffix.shard_task(blocks, 50, 16)((0,), texts_of)
    gone = set()
    for table in (spans.filter(pa.compute.less(spans.column("group"), 0)), found):
        for d, a, b in zip(*(x.tolist() for x in suffix.spans_of(table)), strict=True):
            gone |= {(d, i) for i in range(a, b)}
    return gone


def brute(texts, length=50):
    first, gone = {}, set()
    for d, t in sorted(texts):
        for i in range(len(t) - length + 1):
            if first.setdefault(t[i : i + length], d) < d:
                gone |= {(d, j) for j in range(i, i + length)}
    return gone


def common(n):
    return [(i, f"{prose(3 * i, 9)}{chr(33 + i)}{LINE}{chr(33 + i)}{prose(3 * i + 1, 9)}") for i in range(1, n + 1)]


def test_a_common_line_is_sorted_once(monkeypatch):
    sizes, covered = [], suffix.covered_windows
    monkeypatch.setattr(suffix, "covered_windows", lambda texts, *rest: sizes.append(len(texts)) or covered(texts, *rest))
    for n in (20, 80):
        assert judged(common(n)) == brute(common(n))
    assert sizes[1] <= sizes[0] + 500  # before, four times as many bytes


@pytest.mark.parametrize("small", [False, True])
def test_parts_that_a_document_repeats_itself(monkeypatch, small):
    if small:  # many parts of a fragment, of keys and of texts
        for name in ("PART", "PIECE", "STRIP"):
            monkeypatch.setattr(suffix, name, 64)
    a, b = prose(7, 30), prose(8, 30)
    texts = [(5, f"{a} x {LINE} y {LINE} {LINE} z"), (9, f"{LINE} {b[:120]} {a[20:140]} {LINE[4:70]}"),
             (11, f"{b} q {a[10:90]}{a[10:90]} {LINE[2:64]}"), (12, f"{a[60:]} r {b[30:]} {LINE[9:]}"), (13, ""), (14, "short"),
             (2, a[25:100]), (20, f"{b[5:]} {LINE}{LINE}"), *((i + 30, t) for i, t in common(12))]
    assert judged(texts) == brute(texts)
