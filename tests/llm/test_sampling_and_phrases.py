"""Importance resampling, sharding and collocations against brute force."""

import hashlib
import math
import os
import re
import sys
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest import AWKWARD, prose  # noqa: E402

from panelloom.llm import collocations, resample, sharding  # noqa: E402
from panelloom.llm.common import SpanHasher, numbered, read, stage  # noqa: E402


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---- 11: importance resampling ------------------------------------------------------------


def runs_of(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    found = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(f.encode()) for f in found]


def resampled(docs, target, share, least, seed, longest, buckets):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(c % buckets for c in runs_of(text, longest)[1])
    for text in target:
        t.update(c % buckets for c in runs_of(text, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((n + 1) * (all_t + buckets)))) for b, n in s.items()}
    out = []
    for doc_id, text in docs:
        n, found = runs_of(text, longest)
        weight = sum(gain[c % buckets] for c in found)
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, n, len(found), weight, score, None])
    pool = sorted((r for r in out if r[4] is not None and r[1] >= least), key=lambda r: (-r[4], r[0]))
    for i, r in enumerate(pool[: share * len(pool) // 100]):
        r[5] = i + 1
    return out


@pytest.mark.parametrize("longest, share", [(1, 10), (3, 50)])
def test_resampling_equals_brute_force(spark, documents, longest, share):
    docs = [(i, prose(i, 15 + i % 40)) for i in range(300)]
    docs += [(1000 + i, t) for i, t in AWKWARD] + [(None, prose(7, 30)), (2000, "Ünïcode ÄÖ 123 " * 30), (2001, "x" * 3000 + " y" * 40)]
    target = [prose(i, 20) for i in (3, 5, 8)] + [None, "", "garden2 silver1 " * 30]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.importance_resample(documents(*docs), bench, share, 20, 2024, longest, 500)
    want = resampled(docs, target, share, 20, 2024, longest, 500)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(map(tuple, want), key=key)


def test_repeated_ids_are_drawn_one_by_one(spark, documents):
    got = resample.importance_resample(documents(*[(1, prose(1, 30))] * 40), documents((1, "a")), 25).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11))
    assert len({(r["score"], r["weight"]) for r in got}) == 1


def test_resampling_of_nothing(spark, documents):
    nothing = documents((1, "a")).where("doc_id < 0")
    assert resample.importance_resample(nothing, documents((1, "a"))).count() == 0
    assert resample.importance_resample(documents((1, "a")), nothing).first()["rank"] is None


def test_bracket_is_widened_until_it_holds(spark, monkeypatch):
    scores = spark.range(5000).select((F.col("id") * 7 % 5000).alias("score"))
    monkeypatch.setattr(resample, "SKETCH_SIZE", 8)
    monkeypatch.setattr(resample, "BRACKET", 0.0002)
    for wanted in (1, 77, 2500, 5000):
        low, high, above = resample.bracket(scores, "score", wanted, 5000)
        cut = 5000 - wanted
        assert (low is None or low <= cut) and (high is None or high >= cut)
        assert above == (0 if high is None else 4999 - high)


def test_crc_of_spans():
    data = np.frombuffer(b"".join(bytes([i % 251]) * (i % 90) for i in range(200)), np.uint8)
    start = np.cumsum([0] + [i % 90 for i in range(199)])
    end = start + np.array([i % 90 for i in range(200)])
    got = resample.crc_of_spans(data, start, end, np.full(200, 0xFFFFFFFF, np.uint32)) ^ np.uint32(0xFFFFFFFF)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]


# ---- numbering and sharding ----------------------------------------------------------------


def test_numbers_have_no_gap_where_one_group_and_one_value_are_hot(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"),
        F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 9).alias("v"),
    )
    staged, _ = stage(rows, "rows")
    got = numbered(staged, ["g"], [F.col("v").asc()], "at")[0].toPandas().sort_values(["g", "at"])
    for _, part in got.groupby("g"):
        assert part["at"].tolist() == list(range(len(part)))
        assert part["v"].is_monotonic_increasing
    assert len(got) == 20000


def brute_shard(key, weights):
    def number(i, w):
        u = (int(hashlib.md5(f"{i}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -w / math.log(u)

    return max(range(len(weights)), key=lambda i: number(i, weights[i]))


def test_shards_equal_brute_force_and_grow_into_the_new_one_only(spark, documents):
    docs = [(i, prose(i, 5)) for i in range(400)] + [(None, "no id"), (None, None), (7, "again"), (900, None), (901, "é")]
    got = sharding.shard_documents(documents(*docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        if r["doc_id"] is not None:
            assert r["shard"] == brute_shard(r["doc_id"], [1.0] * 16)
            assert r["grown_shard"] == brute_shard(r["doc_id"], [1.0] * 17)
        assert r["grown_shard"] in (r["shard"], 16)
    slots = Counter(r["shard"] for r in got)
    assert {(r["shard"], r["slot"]) for r in got} == {(s, i) for s, n in slots.items() for i in range(n)}
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert (by_id[900]["size"], by_id[900]["text_crc32"]) == (1, 0)
    assert (by_id[901]["size"], by_id[901]["text_crc32"]) == (3, zlib.crc32("é".encode()))
    assert sharding.shard_documents(documents((1, "a")).where("doc_id < 0")).count() == 0


def test_weights_give_shares(spark):
    weights = [1.0, 2.0, 5.0]
    rows = sharding.assign_shards(spark.range(8000), F.col("id").cast("string"), weights)
    found = {r["shard"]: r["count"] / 8000 for r in rows.groupBy("shard").count().collect()}
    for i, w in enumerate(weights):
        assert abs(found[i] - w / 8) < 0.02
    # Less weight for one shard moves rows out of that shard only.
    less = sharding.assign_shards(rows, F.col("id").cast("string"), [1.0, 2.0, 3.0], "now")
    assert less.where("now <> shard AND shard <> 2").count() == 0


def test_written_shards_hold_every_row(spark, documents, tmp_path):
    docs = documents(*AWKWARD, (None, "x"), *[(5, "same")] * 50).withColumn("shard", F.lit("own"))
    manifest = sharding.write_shards(docs, str(tmp_path / "out"), [1.0, 3.0]).collect()
    back = spark.read.parquet(str(tmp_path / "out")).select("record.*")
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
    assert sum(r["rows"] for r in manifest) == len(AWKWARD) + 51


# ---- 13: collocations ------------------------------------------------------------------------


def mined(docs, longest, least, percent, top):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        around = [b for (other, q), b in f.items() if other == lang and len(q) > len(p) and b >= least
                  and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= percent * a for b in around):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(ranked)


def phrase_docs():
    docs = [(prose(i, 60).replace("3 ", ", ").replace("5", ""), ("en", "de", None)[i % 3]) for i in range(60)]
    docs += [(t, "en") for _, t in AWKWARD]
    docs += [("New York\tCity is big. New York; york City\nnew\x0byork \x85 city", "en")] * 9
    docs += [("a a a a a a a a", "de")] * 5 + [("w" * 2000 + " " + "w" * 2000, "de")] * 4 + [("é ü", "und")] * 6
    return docs


@pytest.mark.parametrize("percent, top", [(100, 2000), (60, 5)])
def test_collocations_equal_brute_force(spark, documents, percent, top):
    docs = phrase_docs()
    df = documents(*[(i, t, lang) for i, (t, lang) in enumerate(docs)])
    got = collocations.mine_collocations(df, 4, 4, percent, top).collect()
    want = mined(docs, 4, 4, percent, top)
    assert want and sorted(tuple(r) for r in got) == want


@pytest.mark.parametrize("name, value", [("DENSE", 2), ("RANKS", 4), ("HELD", 50), ("BLOCK", 300), ("TABLE_BITS", 64)])
def test_collocations_do_not_depend_on_sizes(spark, documents, monkeypatch, name, value):
    """Dense tiles, few ranks, small blocks and a full bit table give the same phrases."""
    monkeypatch.setattr(collocations, name, value)
    if name == "RANKS":
        monkeypatch.setattr(collocations, "EDGE", 2)
    docs = phrase_docs()
    df = documents(*[(i, t, lang) for i, (t, lang) in enumerate(docs)])
    got = collocations.mine_collocations(df, 5, 4).collect()
    assert sorted(tuple(r) for r in got) == mined(docs, 5, 4, 100, 2000)


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**15 + 7, 10**17 + 3, 10**15 + 11, 10**16 + 1), (123456789012345, 10**17, 123456789012399, 987654321098765)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select(collocations.exact_score("a", "n", "l", "r").alias("s"))
    assert [r["s"] for r in got.collect()] == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_collocations_of_nothing(spark, documents):
    for df in (documents((1, "a")).where("doc_id < 0"), documents((1, None), (2, ""), (3, " . "))):
        assert collocations.mine_collocations(df, 5, 1).count() == 0


def test_long_words_of_two_letters_differ():
    """Words whose polynomials agree modulo 2^64 are told apart."""
    a = b = b""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    a, b = word.encode(), word.translate(str.maketrans("ab", "ba")).encode()
    data = np.frombuffer(a + b" " + b, np.uint8)
    n = len(a)
    got = collocations.hash_words(SpanHasher(), data, np.array([0, n + 1]), np.array([n, 2 * n + 1]))
    assert got[0] != got[1]


def test_counting_held_pairs_needs_little_memory():
    """A task holds ``HELD`` pairs and counts them; six such tasks share an executor with the JVM."""
    rng = np.random.default_rng(0)
    known = np.sort(rng.integers(1, 1 << 62, collocations.RANKS).astype(np.uint64))
    places = np.arange(len(known))
    level = collocations.Level(np.zeros(1, np.uint64), known, np.zeros_like(places), places, known, np.zeros(1, np.int64))
    unit, word = (rng.choice(known, collocations.HELD) for _ in range(2))
    tracemalloc.start()
    try:
        counted = collocations.count_pairs(unit, word, level, level)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(counted.column("f").to_pylist()) == collocations.HELD
    assert peak < 200 << 20
