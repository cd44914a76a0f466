"""Phrase collocation mining by direct-address tiling.

Words are ranked by frequency. A phrase of k+1 words is a *pair* of a unit (its first k words)
and a word, so counting phrases is counting pairs, level by level:

1. The most frequent units and words have ranks. A pair of ranks is a cell of a square tile;
   frequent words share few tiles, so tasks count a well filled tile with one dense
   ``bincount`` and thin tiles as sorted (unit, word) coordinates. Pairs with a member beyond
   the ranks are sorted coordinates as well.
2. Spark adds the counts of a pair over all tasks, after a map-side sum, and keeps the
   frequent ones.
3. These are ranked by frequency again: they are the units of the next level.

No dictionary travels whole: ranks go to the ``RANKS`` most frequent units, and a bit table of
fixed size says of any unit whether it may be frequent. The table only spares work (a phrase
can be frequent only if its parts are); counts are exact whatever it says.

Units are known by 64-bit hashes. Two of m frequent units share one with probability below
m^2 / 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelloom.session import side

from .common import (
    LOWER, MULTIPLIER, SpanHasher, binary_column, by_key, chunks, discard, mix, run_starts, stage, word_spans,
)

LONGEST = 5
LEAST = 100
RANKS = 1 << 16
# Bits of the table of possibly frequent units: 8 MB, whatever the corpus.
TABLE_BITS = 1 << 26
# Side of a tile; a tile is counted densely from this many pairs on.
EDGE = 1 << 10
DENSE = EDGE * EDGE // 16
# Pairs that a task holds before it counts them; counting takes several times their memory.
HELD = 1 << 19
# Rows of a counted batch that leave a task at once.
SENT = 1 << 16
# Bytes split and hashed at once, and the length from which a word is hashed on its own.
BLOCK = 1 << 20
LONG_WORD = 512
# Decimals wide enough for counts and for products of two of them and 1000.
COUNT = "decimal(18,0)"

WORD_BYTES = np.ones(256, bool)
PIECE_BYTES = np.zeros(256, bool)
PIECE_BYTES[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
WORD_BYTES[PIECE_BYTES] = False
WORD_BYTES[[ord(" "), ord("\t")]] = False


def hash_words(hasher: SpanHasher, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, a block of text at a time."""
    out = np.empty(len(start), np.uint64)
    long = np.flatnonzero(end - start >= LONG_WORD)
    for i in long:
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    short = np.flatnonzero(end - start < LONG_WORD)
    first = 0
    while first < len(short):
        origin = start[short[first]]
        last = int(np.searchsorted(start[short], origin + BLOCK, side="left"))
        part = short[first:last]
        prefix = hasher.prefix(data[origin : end[part[-1]]])
        out[part] = hasher.spans(prefix, start[part] - origin, end[part] - origin)
        first = last
    return out


def extend(unit: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The unit of one word more."""
    return mix(unit * np.uint64(MULTIPLIER) + word)


@dataclass
class Words:
    """The words of some documents in order: spans, hashes (with the language) and pieces."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    unit: np.ndarray
    piece: np.ndarray
    row: np.ndarray


def split_words(hasher: SpanHasher, data: np.ndarray, offsets: np.ndarray, salt: np.ndarray) -> Words:
    """``salt`` is a number per row that tells its language; words of two languages differ."""
    data = LOWER[data]
    start, end, row = word_spans(data, offsets, WORD_BYTES)
    # Both counters never fall, so their sum changes exactly where one of them does.
    breaks = np.flatnonzero(PIECE_BYTES[data])
    piece = np.searchsorted(breaks, start) + row
    unit = mix(hash_words(hasher, data, start, end) + salt[row])
    return Words(data, start, end, unit, piece, row)


def salts(langs: list[str]) -> np.ndarray:
    known = {v: xxhash.xxh3_64_intdigest(v.encode()) for v in set(langs)}
    return np.array([known[v] for v in langs], np.uint64)


def word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """Words of (lang, text) batches and the language of each row."""
    hasher = SpanHasher()
    for batch in batches:
        langs = batch.column(0).to_pylist()
        salt = salts(langs)
        data, offsets = binary_column(batch.column(1))
        for ids, part, cut in chunks(np.arange(batch.num_rows), data, offsets, BLOCK):
            yield split_words(hasher, part, cut, salt[ids]), [langs[i] for i in ids]


def corpus(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text").alias("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, unit, f); a row without a word holds the number of words of a language."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs in word_batches(batches):
            order = np.argsort(words.unit, kind="stable")
            runs = run_starts(words.unit[order])
            if not len(runs):
                continue
            n = np.diff(np.r_[runs, len(order)])
            one = order[runs]
            texts = [words.data[a:b].tobytes() for a, b in zip(words.start[one], words.end[one])]
            lang = [langs[r] for r in words.row[one]]
            totals: dict[str, int] = {}
            for v, k in zip(lang, n.tolist()):
                totals[v] = totals.get(v, 0) + k
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lang + list(totals), pa.string()),
                    pa.array(texts + [None] * len(totals), pa.binary()).cast(pa.string()),
                    pa.array(np.r_[words.unit[one].view(np.int64), np.zeros(len(totals), np.int64)]),
                    pa.array(np.r_[n, list(totals.values())], pa.int64()),
                ],
                names=["lang", "word", "unit", "f"],
            )

    found = docs.mapInArrow(task, "lang string, word string, unit long, f long")
    return found.groupBy("lang", "word").agg(F.first("unit").alias("unit"), F.sum("f").alias("f"))


@dataclass
class Level:
    """What tasks know of the frequent units of one length."""

    table: np.ndarray  # one bit per hash value: may be frequent
    unit: np.ndarray  # the most frequent units, by hash
    lang: np.ndarray  # the number of their language
    rank: np.ndarray  # and their place in it, most frequent first
    ranked: np.ndarray  # the same units by language and rank
    first: np.ndarray  # where a language starts there

    def maybe(self, unit: np.ndarray) -> np.ndarray:
        at = unit & np.uint64(TABLE_BITS - 1)
        return (self.table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0

    def find(self, unit: np.ndarray) -> np.ndarray:
        """Place in ``unit``, or -1."""
        if not len(self.unit):
            return np.full(len(unit), -1)
        at = np.minimum(np.searchsorted(self.unit, unit), len(self.unit) - 1)
        return np.where(self.unit[at] == unit, at, -1)

    def of(self, lang: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return self.ranked[self.first[lang] + rank]


def level_of(frequent: DataFrame, langs: list[str] | None = None) -> tuple[Level, list[str]]:
    """Ranks and bit table of a staged table of frequent units (lang, unit, f).

    The driver sees at most TABLE_BITS / 64 words of bits and RANKS units. ``langs`` numbers
    the languages; units of another one have no rank.
    """
    low = f"(unit & {TABLE_BITS - 1}L)"
    bits = frequent.select(
        F.expr(f"shiftright({low}, 6)").alias("slot"), F.expr(f"shiftleft(1L, CAST({low} & 63 AS INT))").alias("bit")
    )
    bits = bits.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(TABLE_BITS // 64, np.uint64)
    table[bits["slot"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    top = frequent.orderBy(F.col("f").desc(), "unit").limit(RANKS).select("lang", "unit").toArrow()
    names = top["lang"].to_pylist()
    langs = sorted(set(names)) if langs is None else langs
    number = {v: i for i, v in enumerate(langs)}
    lang = np.array([number.get(v, -1) for v in names], np.int64)
    unit = top["unit"].to_numpy().view(np.uint64)[lang >= 0]
    lang = lang[lang >= 0]
    order = np.argsort(lang, kind="stable")  # most frequent first within a language
    first = np.searchsorted(lang[order], np.arange(len(langs)))
    rank = np.empty(len(lang), np.int64)
    rank[order] = np.arange(len(lang)) - first[lang[order]]
    by_hash = np.argsort(unit)
    return Level(table, unit[by_hash], lang[by_hash], rank[by_hash], unit[order], first), langs


def tile_counts(tile: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tile, cell, n) of the distinct cells: full tiles by bincount, thin ones sorted."""
    order, tiles, edge = by_key(tile)
    cell, size = cell[order], np.diff(edge)
    out = []
    for i in np.flatnonzero(size >= DENSE):
        counts = np.bincount(cell[edge[i] : edge[i + 1]], minlength=EDGE * EDGE)
        held = np.flatnonzero(counts)
        out.append((np.full(len(held), tiles[i]), held, counts[held]))
    thin = np.repeat(size < DENSE, size)
    code = np.sort(np.repeat(tiles, size)[thin] * (EDGE * EDGE) + cell[thin])
    runs = run_starts(code)
    out.append((code[runs] // (EDGE * EDGE), code[runs] % (EDGE * EDGE), np.diff(np.r_[runs, len(code)])))
    return tuple(np.concatenate(c) for c in zip(*out))


def count_pairs(unit: np.ndarray, word: np.ndarray, units: Level, words: Level) -> pa.RecordBatch:
    """Distinct (unit, word) pairs and how often each occurs."""
    a, b = units.find(unit), words.find(word)
    ranked = (a >= 0) & (b >= 0)
    a, b = a[ranked], b[ranked]
    across = RANKS // EDGE
    ra, rb = units.rank[a], words.rank[b]
    # A unit and its next word are of one language.
    tile = (words.lang[b] * across + ra // EDGE) * across + rb // EDGE
    tile, cell, n = tile_counts(tile, ra % EDGE * EDGE + rb % EDGE)
    lang = tile // (across * across)
    dense_u = units.of(lang, tile // across % across * EDGE + cell // EDGE)
    dense_w = words.of(lang, tile % across * EDGE + cell % EDGE)
    u, w = unit[~ranked], word[~ranked]
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    runs = run_starts(u, w)
    columns = (
        np.r_[dense_u, u[runs]].view(np.int64), np.r_[dense_w, w[runs]].view(np.int64),
        np.r_[n, np.diff(np.r_[runs, len(u)])].astype(np.int64),
    )
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["unit", "word", "f"])


def count_extensions(docs: DataFrame, k: int, units: Level, words: Level, least: int) -> DataFrame:
    """(unit, word, f) of the frequent phrases of k + 1 words, given the levels k and 1."""

    def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        batch = count_pairs(*(np.concatenate(c) for c in zip(*held)), units, words)
        for first in range(0, batch.num_rows, SENT):
            yield batch.slice(first, SENT)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for found, _ in word_batches(batches):
            m = len(found.unit) - k
            if m <= 0:
                continue
            unit = found.unit
            for j in range(1, k):
                unit = extend(unit[:-1], found.unit[j:])
            good = (found.piece[:m] == found.piece[k:]) & units.maybe(unit[:m]) & words.maybe(found.unit[k:])
            if k > 1:
                good &= units.maybe(unit[1:])
            held.append((unit[:m][good], found.unit[k:][good]))
            size += len(held[-1][0])
            if size >= HELD:
                yield from counted(held)
                held, size = [], 0
        if size:
            yield from counted(held)

    pairs = docs.mapInArrow(task, "unit long, word long, f long")
    return pairs.groupBy("unit", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def longer(counted: DataFrame, units: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, unit, f) of counted pairs, one word longer than ``units``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, word = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            new = pa.array(extend(unit, word).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=["unit", "word", "f", "new"])

    named = counted.mapInArrow(task, "unit long, word long, f long, new long")
    front = units.select("unit", "lang", F.col("phrase").alias("front"))
    back = words.select(F.col("unit").alias("word"), F.col("phrase").alias("back"))
    joined = named.join(front, "unit").join(back, "word")
    return joined.select("lang", F.concat("front", "back").alias("phrase"), F.col("new").alias("unit"), "f")


def frequent_phrases(docs: DataFrame, longest: int, least: int) -> tuple[list[DataFrame], DataFrame, list[str]]:
    """Frequent phrases by length (lang, phrase, unit, f), words per language, staged paths."""
    docs = corpus(docs)
    counted, path = stage(count_words(docs).where((F.col("f") >= least) | F.col("word").isNull()), "words")
    paths = [path]
    totals = counted.where("word IS NULL").select("lang", F.col("f").alias("n"))
    words = counted.where("word IS NOT NULL").select("lang", F.array("word").alias("phrase"), "unit", "f")
    first, langs = level_of(words)
    levels, level = [words], first
    for k in range(1, longest):
        pairs, pairs_path = stage(count_extensions(docs, k, level, first, least), "pairs")
        found, path = stage(longer(pairs, levels[-1], words), "phrases")
        discard(docs.sparkSession, pairs_path)
        paths.append(path)
        levels.append(found)
        if found.isEmpty():
            break
        level, _ = level_of(found, langs)
    return levels, totals, paths


def exact_score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)) without rounding: 38 decimals hold the products."""
    top = f"CAST(1000 AS decimal(4,0)) * CAST({a} AS {COUNT}) * CAST({n} AS {COUNT})"
    return F.expr(f"({top}) div (CAST({left} AS {COUNT}) * CAST({right} AS {COUNT}))")


def scored_cuts(candidates: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the lowest-scoring cut of each candidate."""
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)))
    cut = cut.select(
        "lang", "phrase", "a", "k",
        F.slice("phrase", F.lit(1), F.col("k")).alias("left"),
        F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")).alias("right"),
    )
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cut = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(side(totals), "lang")
    cut = cut.withColumn("score", exact_score("a", "n", "l", "r"))
    least = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return least.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")


def not_covered(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates without a longer one around them of at least ``percent`` of their count."""
    whole = candidates.where(F.size("phrase") > 2)
    size = F.size("phrase")
    inner = whole.withColumn("m", F.explode(F.sequence(F.lit(2), size - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)))
    inner = inner.select("lang", F.slice("phrase", F.col("at"), F.col("m")).alias("phrase"), "a")
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    joined = candidates.join(around, ["lang", "phrase"], "left")
    kept = F.col("around").isNull() | (100 * F.col("around") < percent * F.col("a"))
    return joined.where(kept).drop("around")


def mine_collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, percent: int = 100, top: int = 2000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language.

    A null text is empty, a null language is ``und``. Copies of a document count as often as
    they occur. Equal scores are ordered by count and phrase, so ranks are unique. Texts without
    words and an empty table give no rows. Only lang and text are read.
    """
    spark = docs.sparkSession
    levels, totals, paths = frequent_phrases(docs, longest, least)
    parts = levels[0]
    for level in levels[1:]:
        parts = parts.unionByName(level)
    candidates = parts.where(F.size("phrase") > 1).select("lang", "phrase", F.col("f").alias("a"))
    scored = scored_cuts(not_covered(candidates, percent), parts, totals)
    scored = scored.withColumn("phrase", F.array_join("phrase", " "))
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    # The limit is pushed below the shuffle: a task sends at most ``top`` rows of a language.
    best = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    out, _ = stage(best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(spark, *paths)
    return out
