"""Benchmark passages in documents by the q-gram lemma and banded alignment.

A benchmark item of m bytes that occurs with at most e edits shares at least
m - q + 1 - q e of its q-grams with the place, on diagonals (place in the document minus
place in the item) that differ by at most e. Shared q-grams are therefore counted in bands
of diagonals that overlap by half, bands below the bound are dropped, and what is left is
aligned inside its band. Items shorter than a q-gram are looked for as they are. The
benchmark is the query set: it is held in blocks of bounded size, every block against all
documents.

Repetitive text meets repetitive items in as many places as the product of both. So the
places of one q-gram that are no farther apart than a band is wide are one run, a run and a
place in the item make an interval of bands, and intervals are added up, not places.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, binary_column, chunks, mix, run_starts

Q = 10
EDIT_SHARE = 0.06  # edits allowed for each byte of an item
BLOCK_BYTES = 1 << 22  # of benchmark text that travels to tasks at once
FILTER_BITS = 22
SPREAD = 1 << 20  # intervals held at once
WORD = 8  # bytes compared as one number

# Texts come in lower case; all ASCII white space counts as one kind (fixed values).
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x09:0x0E] = 0x20


def folded(text: bytes) -> np.ndarray:
    return FOLD[np.frombuffer(text, np.uint8)]


def edit_budget(size: int, q: int, share: float) -> int:
    """Edits of an item, at most as many as leave one shared q-gram certain."""
    return max(0, min(int(size * share), (size - q) // q))


def banded_alignment(item: np.ndarray, text: np.ndarray, first: int, last: int, budget: int) -> tuple[int, int, int] | None:
    """Best place of the item in the text on diagonals first..last: (start, end, edits).

    Column d of a row holds the fewest edits of an item prefix that ends on that diagonal,
    and where in the text its match began. None if more than ``budget`` edits are needed.
    """
    width = last - first + 1
    far = len(item) + len(text) + 1
    diagonal = np.arange(first, last + 1)
    offset = np.arange(width)
    inside = (diagonal >= 0) & (diagonal <= len(text))
    cost = np.where(inside, 0, far)
    start = np.clip(diagonal, 0, len(text))
    for i in range(1, len(item) + 1):
        at = diagonal + i - 1  # the byte that a step along the diagonal reads
        readable = (at >= 0) & (at < len(text))
        differs = np.ones(width, np.int64)
        differs[readable] = text[at[readable]] != item[i - 1]
        along = np.where(readable, cost + differs, far)
        skip = np.r_[cost[1:] + 1, far]  # an item byte without counterpart
        better = skip < along
        best = np.where(better, skip, along)
        begin = np.where(better, np.r_[start[1:], 0], start)
        # Text bytes without counterpart: carry the best value to later diagonals.
        carried = np.minimum.accumulate(best - offset)
        source = np.maximum.accumulate(np.where(best - offset == carried, offset, 0))
        total = carried + offset
        use = total < best
        begin = np.where(use, begin[source], begin)
        end = diagonal + i
        cost = np.where((end >= 0) & (end <= len(text)), np.where(use, total, best), far)
        start = begin
        if cost.min() > budget:
            return None
    d = int(np.argmin(cost))
    return int(start[d]), int(diagonal[d] + len(item)), int(cost[d])


def words_at(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` <= 8 bytes from every place on as one number, zeros behind the end."""
    padded = np.concatenate([data, np.zeros(WORD, np.uint8)])
    found = np.ndarray(len(data), np.dtype("<u8"), padded, 0, (1,))
    return found if size == WORD else found & np.uint64((1 << 8 * size) - 1)


def gram_key(words: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q bytes from each place on; ``words`` holds 8 (or all q < 8) bytes of every place."""
    key = words[at]
    for step in [*range(WORD, q - WORD, WORD), *([q - WORD] if q > WORD else [])]:
        key = mix(key * np.uint64(MULTIPLIER)) + words[at + step]
    return mix(key)


def filter_slot(words: np.ndarray) -> np.ndarray:
    return (words * np.uint64(MULTIPLIER) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class GramIndex:
    """Places of the q-grams of some items, by hash."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int) -> None:
        self.q = q
        hashes, owner, place, first = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        for n, text in items:
            at = np.arange(max(len(text) - q + 1, 0))
            words = words_at(text, min(q, WORD))
            first.append(filter_slot(words[at]))
            hashes.append(gram_key(words, at, q))
            owner.append(np.full(len(at), n))
            place.append(at)
        self.hash = np.concatenate(hashes)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.owner, self.place = self.hash[order], np.concatenate(owner)[order], np.concatenate(place)[order]
        # A gram can only be there if its first bytes are.
        self.present = np.zeros(1 << FILTER_BITS, bool)
        for slots in first:
            self.present[slots] = True

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, place in the row, hash) of every gram of the items inside a row."""
        words = words_at(data, min(self.q, WORD))
        at = np.flatnonzero(self.present[filter_slot(words)])
        row = np.searchsorted(offsets, at, side="right") - 1
        whole = at + self.q <= offsets[row + 1]
        at, row = at[whole], row[whole]
        key = gram_key(words, at, self.q)
        spot = np.minimum(np.searchsorted(self.hash, key), max(len(self.hash) - 1, 0))
        held = self.hash[spot] == key if len(self.hash) else np.zeros(len(key), bool)
        return row[held], at[held] - offsets[row[held]], key[held]


class Benchmark:
    """One block of items: their q-grams, and whole those that are shorter."""

    def __init__(self, items: list[tuple[int, bytes]], q: int, share: float) -> None:
        self.items = [(i, folded(t)) for i, t in items if len(t)]
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        self.budget = np.array([edit_budget(len(t), q, share) for _, t in self.items], np.int64)
        self.need = np.maximum(self.size - q + 1 - q * self.budget, 1)
        numbered = [(n, t) for n, (_, t) in enumerate(self.items)]
        self.all = GramIndex([x for x in numbered if len(x[1]) >= q], q)
        # Items of one edit budget have bands of one width.
        self.classes = []
        for e in sorted({int(self.budget[n]) for n, t in numbered if len(t) >= q}):
            own = np.flatnonzero(self.budget[self.all.owner] == e)
            self.classes.append((e, self.all.hash[own], self.all.owner[own], self.all.place[own]))
        self.short = []
        for size in sorted({len(t) for _, t in numbered if len(t) < q}):
            self.short.append(GramIndex([x for x in numbered if len(x[1]) == size], size))

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of every passage found."""
        data = FOLD[data]
        out = []
        if len(self.all.hash):
            row, at, key = self.all.find(data, offsets)
            order = np.lexsort((at, key, row))
            row, at, key = row[order], at[order], key[order]
            for budget, hashes, owner, place in self.classes:
                bands = self.full_bands(row, at, key, budget, hashes, owner, place)
                out += self.aligned(data, offsets, budget, bands)
        for index in self.short:
            row, at, key = index.find(data, offsets)
            for n in range(len(index.hash)):
                own = key == index.hash[n]
                ends: dict[int, int] = {}
                for r, a in zip(row[own].tolist(), at[own].tolist()):
                    if a >= ends.get(r, 0):
                        ends[r] = a + index.q
                        out.append((r, int(index.owner[n]), a, a + index.q, 0))
        return out

    def full_bands(self, row, at, key, budget, hashes, owner, place) -> list[tuple[int, int, int, int]]:
        """(row, item, first band, last band) of runs of bands that hold enough distinct q-grams."""
        low = np.searchsorted(hashes, key)
        count = np.searchsorted(hashes, key, side="right") - low
        held = count > 0
        row, at, key, low, count = row[held], at[held], key[held], low[held], count[held]
        if not len(row):
            return []
        width = budget + 1
        # Places of one q-gram up to a band apart: no band between them holds neither.
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (at[1:] - at[:-1] > width)
        begin = np.flatnonzero(fresh)
        final = np.r_[begin[1:], len(row)] - 1
        row, first, last, low, count = row[begin], at[begin], at[final], low[begin], count[begin]
        out = []
        total = np.cumsum(count)
        cut = 0
        while cut < len(row):
            end = int(np.searchsorted(total, (total[cut - 1] if cut else 0) + SPREAD, side="right"))
            # Whole rows, so that every band is counted in one go.
            end = len(row) if end >= len(row) else int(np.searchsorted(row, row[max(end, cut)], side="left"))
            if end <= cut:
                end = int(np.searchsorted(row, row[cut], side="right"))
            out += self.count_bands(row[cut:end], first[cut:end], last[cut:end], low[cut:end], count[cut:end], width, owner, place)
            cut = end
        return out

    def count_bands(self, row, first, last, low, count, width, owner, place) -> list[tuple[int, int, int, int]]:
        spread = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        item, inner = owner[spread], place[spread]
        row, first, last = (np.repeat(c, count) for c in (row, first, last))
        # Band b holds the diagonals b w to (b + 2) w - 1, so each overlaps its neighbours by half.
        start, stop = np.floor_divide(first - inner, width) - 1, np.floor_divide(last - inner, width)
        order = np.lexsort((start, inner, item, row))
        row, item, inner, start, stop = (c[order] for c in (row, item, inner, start, stop))
        # A q-gram of the item counts once in a band: what an earlier interval of it holds is cut off.
        same = np.zeros(len(row), bool)
        same[1:] = (row[1:] == row[:-1]) & (item[1:] == item[:-1]) & (inner[1:] == inner[:-1])
        group = np.cumsum(~same)
        shift = int(stop.max() - start.min()) + 2
        upto = np.maximum.accumulate(stop + group * shift)
        before = np.r_[start[0] - 1, upto[:-1] - group[1:] * shift]
        start = np.where(same, np.maximum(start, before + 1), start)
        keep = start <= stop
        row, item, start, stop = row[keep], item[keep], start[keep], stop[keep]
        # Where intervals begin and end, the number of q-grams changes.
        r, n, b = np.tile(row, 2), np.tile(item, 2), np.r_[start, stop + 1]
        change = np.r_[np.ones(len(start), np.int64), -np.ones(len(stop), np.int64)]
        order = np.lexsort((b, n, r))
        r, n, b, change = r[order], n[order], b[order], change[order]
        point = run_starts(r, n, b)
        level = np.cumsum(np.add.reduceat(change, point))  # back to zero behind each item's last interval
        full = np.flatnonzero(level >= self.need[n[point]])
        # A level holds up to the next point of the same row and item.
        return [(int(r[point[i]]), int(n[point[i]]), int(b[point[i]]), int(b[point[i + 1]]) - 1) for i in full]

    def aligned(self, data, offsets, budget: int, bands: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        width = budget + 1
        clear: dict[tuple[int, int], int] = {}  # behind a match without edits
        for r, n, first_band, last_band in bands:
            text, item = data[offsets[r] : offsets[r + 1]], self.items[n][1]
            b = first_band
            while b <= last_band:
                # What begins inside a match without edits overlaps it and adds nothing.
                free = clear.get((r, n), b * width - budget)
                b = max(b, (free - budget) // width - 1)
                if b > last_band:
                    break
                first, last = max(b * width - budget, free), (b + 2) * width - 1 + budget
                low_byte = max(first, 0)
                region = text[low_byte : last + len(item) + 1]
                best = banded_alignment(item, region, first - low_byte, last - low_byte, budget)
                if best is not None:
                    found.setdefault((r, n), []).append((best[2], best[0] + low_byte, best[1] + low_byte))
                    if best[2] == 0:
                        clear[r, n] = max(clear.get((r, n), 0), best[1] + low_byte)
                b += 1
        out = []
        for (r, n), places in found.items():
            taken: list[tuple[int, int]] = []  # apart and in order
            for edits, a, b in sorted(set(places)):
                i = bisect.bisect(taken, (a, b))
                if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
                    taken.insert(i, (a, b))
                    out.append((r, n, a, b, edits))
        return out


HITS = "doc_id long, item_id long, start long, end long, edits long"


def search_task(index_of: Callable[[], tuple]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Benchmark(*index_of())
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = binary_column(batch.column("text"))
            rows = []
            for part, raw, cut in chunks(ids, data, offsets):
                rows += [(int(part[r]), index.items[n][0], a, b, e) for r, n, a, b, e in index.hits(raw, cut)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns],
                                             ["doc_id", "item_id", "start", "end", "edits"])

    return run


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[int, bytes]]]:
    """Items in blocks of bounded size, read one block at a time from a cut by size."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).cast("binary").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-size // block_bytes)
    blocks = []
    for n in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == n)
        blocks.append(sorted((r["item_id"], bytes(r["text"])) for r in part.toLocalIterator()))
    return blocks


def find_passages(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Benchmark items in documents: doc_id, item_id, start, end (bytes of the lower-case text), edits.

    One row for each separate place where an item occurs with at most
    min(share x bytes, (bytes - q) / q) edits after folding case and white space. Null and
    empty texts contain nothing and empty items occur nowhere; items shorter than ``q`` bytes are
    found without edits, places that do not overlap from the left; repeated rows are each judged; other columns are ignored; empty tables give an empty result.
    Documents are not shuffled.
    """
    rows = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).cast("binary").alias("text"))
    spark = docs.sparkSession
    found = []
    for block in benchmark_blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast((block, q, share))
        found.append(rows.mapInArrow(search_task(lambda shared=shared: shared.value), HITS))
    if not found:
        return spark.createDataFrame([], HITS)
    return reduce(DataFrame.union, found)
