"""Packed rows: what is sent per set, and that nothing is lost by it."""

import numpy as np

from panelloom.llm import jaccard


def test_a_set_is_named_once_in_a_fragment_and_its_size_travels_once():
    sets, sizes = np.arange(1, 41, dtype=np.uint64), np.full(40, 300)
    hashes = np.random.default_rng(1).integers(0, 2**63, (40, 300)).astype(np.uint64)
    out = jaccard.deal(sets, sizes, np.repeat(np.arange(40), 300), np.sort(hashes, axis=1).ravel(), 64)
    runs = sum(len(r[3]) // 8 for r in out if r[0] >= 0)
    sent = sum(len(b) for r in out for b in r[2:])
    assert runs > 40 * 60
    assert sent <= 5 * 12_000 + 9 * runs + 16 * 40


def test_runs_longer_than_a_byte_counts():
    piece, length = jaccard.cut_runs(np.array([1, 255, 256, 700]))
    assert piece.tolist() == [0, 1, 2, 2, 3, 3, 3]
    assert length.tolist() == [1, 255, 255, 1, 255, 255, 190]


def test_long_texts_link_in_one_fragment(spark):
    words = [f"w{i}" for i in range(1500)]
    texts = [" ".join(words), " ".join(words[:1400]), " ".join(words[700:]), None]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    got = {tuple(r) for r in jaccard.ngram_groups(docs, fragments=1).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == {(1, 1496, 1), (2, 1396, 1), (3, 796, 3), (4, 0, 4)}
