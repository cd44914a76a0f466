"""Benchmark passages: counting bands against pairs, repetitive texts, short items."""

import random
import resource
import time
from collections import defaultdict

import numpy as np
import pytest

from panelloom.llm import decontaminate
from panelloom.llm.decontaminate import Benchmark, edit_budget


def pair_bands(bench, q, texts):
    """(row, item, band) with enough distinct q-grams, place by place."""
    held = defaultdict(set)
    for r, text in enumerate(texts):
        grams = defaultdict(list)
        for i in range(len(text) - q + 1):
            grams[text[i : i + q]].append(i)
        for n, (_, item) in enumerate(bench.items):
            w, body = int(bench.budget[n]) + 1, item.tobytes()
            if len(body) < q:
                continue
            for j in range(len(body) - q + 1):
                for i in grams.get(body[j : j + q], ()):
                    for b in ((i - j) // w, (i - j) // w - 1):
                        held[r, n, b].add(j)
    return {k for k, v in held.items() if len(v) >= bench.need[k[1]]}


@pytest.mark.parametrize("seed", range(6))
def test_bands_equal_counting_every_pair(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(decontaminate, "SPREAD", 40)
    rng = random.Random(seed)
    letters = "ab" if seed < 3 else "abcdefgh"
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(4, 90))).encode()) for i in range(8)]
    items += [(20, b"-" * 60), (21, b"ab" * 40), (22, b"abc")]
    texts = []
    for _ in range(12):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 200)))
        inside = bytearray(rng.choice(items)[1])
        for _ in range(rng.randint(0, 3)):
            inside[rng.randrange(len(inside))] = ord("x")
        texts.append(text.encode() + bytes(inside) + b"-" * rng.choice([0, 0, 150]) + b"ab" * rng.choice([0, 70]))
    q = 5
    bench = Benchmark(items, q, 0.06)
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    row, at, key = bench.all.find(data, offsets)
    order = np.lexsort((at, key, row))
    got = set()
    for budget, hashes, owner, place in bench.classes:
        for r, n, a, b in bench.full_bands(row[order], at[order], key[order], budget, hashes, owner, place):
            got |= {(r, n, i) for i in range(a, b + 1)}
    assert got == pair_bands(bench, q, texts)


def test_repetitive_text_needs_little_memory_and_time():
    bench = Benchmark([(1, b"-" * 200), (2, b"ab" * 90), (3, b"the end of the line, said the bird")], 10, 0.06)
    text = b"-" * 60_000 + b"ab" * 10_000 + b"the end of the line, said the bird" + b"----------\n" * 500
    before, started = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    found = bench.hits(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) < 1_500_000  # kB
    assert time.time() - started < 120
    assert sum(n == 0 and e == 0 for _, n, _, _, e in found) == 300
    assert [f for f in found if f[1] == 2] == [(0, 2, 80_000, 80_034, 0)]
    spans = sorted((a, b) for _, n, a, b, _ in found if n == 0)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_short_items_are_found_as_they_are(spark, documents):
    docs = documents((1, "Tic tac TIC tac"), (2, "nothing"), (3, None), (4, "tictic ta"), (5, "aaaaa"))
    bench = spark.createDataFrame([(7, "tic"), (8, "tac tic"), (9, "aa"), (10, "")], "item_id long, text string")
    got = decontaminate.find_passages(docs, bench).collect()
    assert sorted(tuple(r) for r in got) == [
        (1, 7, 0, 3, 0), (1, 7, 8, 11, 0), (1, 8, 4, 11, 0), (4, 7, 0, 3, 0), (4, 7, 3, 6, 0), (5, 9, 0, 2, 0), (5, 9, 2, 4, 0)]


def test_grams_of_all_lengths():
    data = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789" * 3, np.uint8)
    for q in (1, 5, 8, 9, 10, 16, 17, 30):
        words = decontaminate.words_at(data, min(q, 8))
        at = np.arange(len(data) - q + 1)
        key = decontaminate.gram_key(words, at, q)
        text = data.tobytes()
        same = defaultdict(set)
        for i in at:
            same[text[i : i + q]].add(int(key[i]))
        assert all(len(v) == 1 for v in same.values()) and len({*map(tuple, same.values())}) == len(same)
    assert edit_budget(200, 10, 0.06) == 12
