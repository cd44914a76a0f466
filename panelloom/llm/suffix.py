"""Exact substring dedup with suffix arrays built by induced sorting.

Which text needs sorting. Every window of ``length`` bytes holds exactly one *anchor*: the
``GRAM``-byte string with the smallest hash, leftmost on ties. Equal windows have equal
anchors, so windows are split into runs with one anchor, and a run can only repeat where its
anchor does. Tasks deal the runs, packed, to fragments by anchor; a fragment drops anchors
of a single document, collapses runs with the same anchor and the same bytes (by 64-bit
hash) into one text, and knows from the documents of that text which copies go whole. What
is left are the different texts around one anchor.

Shard arrays. These texts are fetched from their documents and dealt to shards by anchor. A
shard leaves out texts of which no window's 64-bit hash occurs in another document (equal
windows have equal hashes, so none of these can repeat), joins the others, sorts all suffixes by induced sorting (classify suffixes as larger or
smaller than the next, sort the leftmost smaller ones first, induce all others from them),
computes the permuted common prefixes (in text order, by the suffix that precedes each one)
and so finds runs of suffixes with ``length`` equal bytes; a window goes if the smallest
document of its run is smaller than its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, binary_column, by_key, joined, mix, partitions, run_starts, stage

LENGTH = 50
GRAM = 16
PIECE = 1 << 19  # window starts looked at together
PART = 1 << 18  # runs of a fragment that are sorted and judged together
STRIP = 1 << 18  # bytes of texts whose windows are hashed together
FLUSH = 500_000  # runs a task gathers before it deals them
FEW = 6  # suffixes that are dealt to their buckets one by one
SMALL = 64  # below this alphabet or text size induced sorting has no gain over doubling


# ---- suffix arrays --------------------------------------------------------------------


def doubling_ranks(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling: the recursion on names once the alphabet is large."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        step *= 2


def smaller_type(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix is smaller."""
    n = len(s)
    sign = np.zeros(n, np.int8)
    sign[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    sign[-1] = 1
    at = np.where(sign != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return sign[following] > 0


def induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix array from the leftmost smaller suffixes in order.

    Buckets are swept by first symbol; a whole bucket is taken at a time. Suffixes with the
    bucket's own symbol come back into the bucket and are taken in the next wave, so that the
    order of a one-by-one scan is kept.
    """
    n = len(s)
    symbol_at, small_at = s.item, small.item
    seed_bucket: list[np.ndarray] = np.split(seeds, np.searchsorted(s[seeds], np.arange(1, alphabet)))

    def sweep(order: range, start: Callable[[int], list[np.ndarray]], want_small: bool, flip: bool) -> list[list[np.ndarray]]:
        buckets: list[list[np.ndarray]] = [[] for _ in range(alphabet)]

        def push(items: np.ndarray, symbol: int) -> np.ndarray:
            """Deal what precedes ``items``; returns those with the same symbol."""
            if len(items) <= FEW:
                same_few = []
                for item in items.tolist():
                    if item and small_at(item - 1) == want_small:
                        c = symbol_at(item - 1)
                        if c == symbol:
                            same_few.append(item - 1)
                        else:
                            buckets[c].append(np.array([item - 1]))
                return np.array(same_few, dtype=np.int64)
            before = items[items > 0] - 1
            before = before[small[before] == want_small]
            symbols = s[before]
            same = before[symbols == symbol]
            other = symbols != symbol
            before, symbols = before[other], symbols[other]
            if len(before):
                by = symbols.argsort(kind="stable")
                before, symbols = before[by], symbols[by]
                cut = [0, *((symbols[1:] != symbols[:-1]).nonzero()[0] + 1).tolist(), len(symbols)]
                for c, a, b in zip(symbols[cut[:-1]].tolist(), cut[:-1], cut[1:], strict=True):
                    buckets[c].append(before[a:b])
            return same

        for c in order:
            waves = buckets[c]
            wave = np.concatenate(waves) if waves else np.empty(0, np.int64)
            done = []
            while len(wave):
                done.append(wave)
                wave = push(wave, c)
            buckets[c] = done
            for extra in start(c):
                push(extra[::-1] if flip else extra, c)
        return buckets

    # Larger suffixes, ascending: after a bucket's larger suffixes its sorted seeds follow.
    larger = sweep(range(alphabet), lambda c: [seed_bucket[c]] if len(seed_bucket[c]) else [], False, False)
    # The last suffix has no successor to be induced from and stands first of all.
    # Smaller suffixes, descending; arrays hold each bucket from its end to its start.
    def larger_down(c: int) -> list[np.ndarray]:
        return [np.concatenate(larger[c])] if larger[c] else []

    smaller = sweep(range(alphabet - 1, -1, -1), larger_down, True, True)
    out = []
    for c in range(alphabet):
        out += larger[c]
        if smaller[c]:
            out.append(np.concatenate(smaller[c])[::-1])
        if c == s[n - 1]:
            out.append(np.array([n - 1]))  # the unique smallest symbol ends the text
    return np.concatenate(out)


def suffix_array(s: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix array of integers in 0..alphabet-1 whose last is a unique 0."""
    n = len(s)
    if n < SMALL or alphabet > max(SMALL, n // 8):
        return doubling_ranks(s)
    small = smaller_type(s)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(left) < 2:
        seeds = left
    else:
        # Sort the substrings between leftmost smaller positions by inducing from any order.
        rough = induce(s, small, left[np.argsort(s[left], kind="stable")], alphabet)
        is_left = np.zeros(n, bool)
        is_left[left] = True
        sorted_left = rough[is_left[rough]]
        name = np.empty(len(left), np.int64)
        place = np.empty(n, np.int64)
        place[left] = np.arange(len(left))
        index = place[sorted_left]
        size = np.r_[np.diff(left), 1] + 1  # with the first symbol of the next one
        size[-1] = n - left[-1]
        different = np.ones(len(left), bool)
        same = size[index[1:]] == size[index[:-1]]
        pairs = np.flatnonzero(same)
        a, b = left[index[pairs]], left[index[pairs + 1]]
        length = size[index[pairs]]
        depth = 0
        while len(pairs):
            equal = s[a + depth] == s[b + depth]
            pairs, a, b, length = pairs[equal], a[equal], b[equal], length[equal]
            depth += 1
            ended = length == depth
            different[pairs[ended] + 1] = False
            pairs, a, b, length = pairs[~ended], a[~ended], b[~ended], length[~ended]
        names = np.cumsum(different) - 1
        name[index] = names
        if names[-1] == len(left) - 1:
            seeds = sorted_left
        else:
            # The last leftmost smaller position is the unique end symbol: its name is 0.
            seeds = left[suffix_array(name, int(names[-1]) + 1)]
    return induce(s, small, seeds, alphabet)


def repeats_previous(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """In suffix order: does a suffix share ``length`` symbols with the one before it?

    The permuted common prefixes cut at ``length``: phi gives each text position the suffix
    before it in the order, and the comparison runs in text order, eight symbols at a time.
    """
    n = len(data)
    phi = np.full(n, n, np.int64)
    phi[order[1:]] = order[:-1]
    padded = np.r_[data.astype(np.uint64), np.zeros(length + 9, np.uint64)]
    # Symbols have 9 bits with the separator: seven of them fit into a word.
    word = np.zeros(n + length + 2, np.uint64)
    for j in range(7):
        word |= padded[j : j + len(word)] << np.uint64(9 * j)
    same = phi < n
    same &= (np.arange(n) + length <= n) & (phi + length <= n)
    at = np.flatnonzero(same)
    other = phi[at]
    for offset in [*range(0, length - 7, 7), length - 7]:
        equal = word[at + offset] == word[other + offset]
        at, other = at[equal], other[equal]
    permuted = np.zeros(n, bool)
    permuted[at] = True
    return permuted[order]


def covered_windows(texts: np.ndarray, offsets: np.ndarray, document: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that a text with a smaller document holds too: (text, start) of each."""
    count = len(offsets) - 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(count), sizes)
    place = np.arange(len(texts)) + owner  # one separator after each text
    data = np.ones(len(texts) + count + 1, np.int64)
    data[place] = texts.astype(np.int64) + 2
    data[-1] = 0
    order = suffix_array(data, 258)
    same = repeats_previous(data, order, length)
    # A window lies inside one text: positions near a text's end are not windows.
    window = np.zeros(len(data), bool)
    inside = np.arange(len(texts)) - np.repeat(offsets[:-1], sizes) + length <= np.repeat(sizes, sizes)
    window[place[inside]] = True
    text_of = np.zeros(len(data), np.int64)
    text_of[place] = owner
    keep = window[order]
    run = np.cumsum(~same)[keep]  # separators differ from text, so a run has only windows
    positions = order[keep]
    doc = document[text_of[positions]]
    begin = run_starts(run)
    if not len(begin):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lowest = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.r_[begin, len(run)]))
    hit = positions[doc > lowest]
    text = text_of[hit]
    return text, hit - text - offsets[text]


# ---- anchors --------------------------------------------------------------------------


NO_RUNS = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint16, np.uint16)


class Anchors:
    """Runs of windows with one anchor, for many documents at once."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        if not 8 <= gram <= length <= gram + 62:
            raise ValueError("length must be in gram..gram + 62 and gram at least 8")
        self.length, self.gram = length, gram
        self.hasher = SpanHasher()

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, first window, last window, anchor hash, hash of the run's bytes, codes of
        the bytes left and right of the anchor).

        Two windows with one anchor can only be equal if ``side`` bytes before it or after it
        are. A code is 0 where no window of the run reaches so far.
        """
        length, gram, n = self.length, self.gram, len(data)
        if n < length:
            return tuple(np.empty(0, t) for t in NO_RUNS)
        prefix = self.hasher.prefix(data)
        start = np.arange(n - gram + 1)
        hashes = self.hasher.spans(prefix, start, start + gram)
        # The low six bits count how far the smallest hash lies behind its window's start.
        low = hashes & ~np.uint64(63)
        width, span = 1, length - gram + 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:] + np.uint64(width))
            width *= 2
        if width < span:
            rest = span - width
            low = np.minimum(low[:-rest], low[rest:] + np.uint64(rest))
        anchor = np.arange(len(low)) + (low & np.uint64(63)).astype(np.int64)
        inside = np.zeros(len(low) + 1, np.int32)
        first, last = offsets[:-1], offsets[1:] - length + 1
        fits = last > first
        np.add.at(inside, first[fits], 1)
        np.add.at(inside, last[fits], -1)
        valid = np.cumsum(inside[:-1]) > 0
        new = valid.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        begin = np.flatnonzero(new | np.isin(np.arange(len(low)), first[fits]) & valid)
        if not len(begin):
            return tuple(np.empty(0, t) for t in NO_RUNS)
        # A run ends before the next one or where its document has no more windows.
        document = np.searchsorted(offsets, begin, side="right") - 1
        end = np.minimum(np.r_[begin[1:], len(low)], last[document]) - 1
        key = hashes[anchor[begin]]
        body = self.hasher.spans(prefix, begin, end + length) + (anchor[begin] - begin).astype(np.uint64)
        at, side = anchor[begin], -(-(length - gram) // 2)
        codes = []
        for a, b, reached in ((at - side, at, at - side >= begin), (at + gram, at + gram + side, at + gram + side <= end + length)):
            code = np.zeros(len(at), np.uint16)
            code[reached] = (self.hasher.spans(prefix, a[reached], b[reached]) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
            codes.append(code)
        return document, begin - offsets[document], end - offsets[document], key, body, *codes


def pieces(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int, size: int = PIECE) -> Iterator[tuple]:
    """Whole documents together, very long ones in pieces that overlap by a window:
    (ids, byte where each starts in its document, bytes, offsets)."""
    first = 0
    while first < len(ids):
        if offsets[first + 1] - offsets[first] > 2 * size:
            a, b = int(offsets[first]), int(offsets[first + 1])
            for at in range(a, b - length + 1, size):
                end = min(at + size + length - 1, b)
                yield ids[first : first + 1], np.array([at - a]), data[at:end], np.array([0, end - at])
            first += 1
            continue
        last = first + 1
        while last < len(ids) and offsets[last + 1] - offsets[first] <= size:
            last += 1
        yield ids[first:last], np.zeros(last - first, np.int64), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


RUNS = pa.schema([
    ("frag", pa.int32()), ("keys", pa.binary()), ("bodies", pa.binary()), ("starts", pa.binary()),
    ("sizes", pa.binary()), ("lefts", pa.binary()), ("rights", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()),
])
RUNS_SQL = ("frag int, keys binary, bodies binary, starts binary, sizes binary, lefts binary, rights binary,"
            " docs binary, counts binary")
SPANS = pa.schema([
    ("block", pa.int32()), ("group", pa.int32()), ("docs", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary()),
    ("keys", pa.binary()),
])
SPANS_SQL = "block int, group int, docs binary, starts binary, ends binary, keys binary"


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def run_task(fragments: int, length: int, gram: int) -> Callable:
    def deal(held: list[tuple]) -> pa.RecordBatch:
        doc, start, end, key, body, left, right = (np.concatenate(c) for c in zip(*held, strict=True))
        order, found, cut = by_key(((key >> np.uint64(32)) % np.uint64(fragments)).astype(np.int32))
        rows = []
        for i, f in enumerate(found):
            at = order[cut[i] : cut[i + 1]]
            begin = run_starts(doc[at])
            rows.append((
                int(f), (key[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), body[at].tobytes(),
                start[at].astype(np.uint32).tobytes(), (end - start)[at].astype(np.uint8).tobytes(),
                left[at].tobytes(), right[at].tobytes(), doc[at][begin].tobytes(), np.diff(np.r_[begin, len(at)]).astype(np.int32).tobytes(),
            ))
        return batch_of(rows, RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Anchors(length, gram)
        held: list[tuple] = []
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = binary_column(batch.column("text"))
            for part, shift, raw, cut in pieces(ids, data, offsets, length):
                document, start, end, key, body, left, right = make.runs(raw, cut)
                held.append((part[document], start + shift[document], end + shift[document], key, body, left, right))
                if sum(len(h[0]) for h in held) >= FLUSH:
                    yield deal(held)
                    held.clear()
        if held:
            yield deal(held)

    return run


def several(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether more than one document has a row's key."""
    parts = -(-len(key) // PIECE)
    if parts > 1:  # keys fall into parts that are sorted one after the other
        out, of = np.zeros(len(key), bool), (mix(key.astype(np.uint64)) % np.uint64(parts)).astype(np.uint16)
        for i in range(parts):
            at = np.flatnonzero(of == i)
            out[at] = several_of(key[at], doc[at])
        return out
    return several_of(key, doc)


def several_of(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    begin = run_starts(key[order])
    out = np.zeros(len(key), bool)
    if len(begin):
        low, high = np.minimum.reduceat(doc[order], begin), np.maximum.reduceat(doc[order], begin)
        out[order] = np.repeat(high > low, np.diff(np.r_[begin, len(key)]))
    return out


def fragment_task(fragments: int, blocks: int, length: int) -> Callable:
    """One fragment of anchors: spans that go whole (group -1) and texts to be sorted."""

    def judged(anchor: np.ndarray, body: np.ndarray, doc: np.ndarray, near: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Runs sorted by anchor, body and document: which go whole, and which are texts to compare."""
        n = len(anchor)
        group, text = run_starts(anchor), run_starts(anchor, body)
        group_size, text_size = np.diff(np.r_[group, n]), np.diff(np.r_[text, n])
        lowest_doc = np.repeat(np.minimum.reduceat(doc, group), group_size)
        own_low = np.repeat(doc[text], text_size)  # sorted by document inside a text
        whole = doc > own_low
        texts_in_group = np.repeat(np.diff(np.searchsorted(text, np.r_[group, n])), group_size)
        highest = np.repeat(np.maximum.reduceat(own_low, group), group_size)
        # Texts are compared where a group has several whose smallest documents differ and
        # that agree next to the anchor.
        compared = ~whole & (texts_in_group > 1) & (highest > lowest_doc)
        spot = np.flatnonzero(compared)
        number = np.repeat(np.arange(len(group), dtype=np.uint64) << np.uint64(16), group_size)[spot]
        compared[spot] = np.any([(c[spot] > 0) & several(number | c[spot], doc[spot]) for c in near], axis=0)
        return np.flatnonzero(whole), np.flatnonzero(compared)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        fragment = key[0].as_py()
        anchor = joined(table.column("keys"), np.uint32)
        body = joined(table.column("bodies"), np.uint64)
        start = joined(table.column("starts"), np.uint32)
        size = joined(table.column("sizes"), np.uint8)
        left, right = joined(table.column("lefts"), np.uint16), joined(table.column("rights"), np.uint16)
        doc = np.repeat(joined(table.column("docs"), np.int64), joined(table.column("counts"), np.int32))
        # Anchors that occur once are the most: leave them out before the full sort.
        order = np.argsort(anchor, kind="stable")
        a = anchor[order]
        new = np.r_[True, a[1:] != a[:-1]] if len(a) else np.empty(0, bool)
        order = order[~(new & np.r_[new[1:], True])] if len(a) else order
        del a, new
        # Some anchors after the other, each with all its runs.
        group = run_starts(anchor[order])
        cut = np.unique(group[np.searchsorted(group, np.arange(PART, group[-1] + 1, PART))]) if len(group) else group
        chosen: tuple[list[np.ndarray], list[np.ndarray]] = ([order[:0]], [order[:0]])
        for at in np.split(order, cut) if len(order) else []:
            at = at[np.lexsort((start[at], doc[at], body[at], anchor[at]))]
            for kept, on in zip(chosen, judged(anchor[at], body[at], doc[at], [left[at], right[at]]), strict=True):
                kept.append(at[on])
        out: list[tuple] = []
        for parts, kind in zip(chosen, (-1, fragment), strict=True):
            by = np.concatenate(parts)
            by = by[np.argsort(doc[by] % blocks, kind="stable")]
            block = doc[by] % blocks
            edge = np.r_[run_starts(block), len(by)]
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                at = by[x:y]
                out.append((
                    int(block[x]), kind, doc[at].tobytes(), start[at].tobytes(),
                    (start[at] + size[at] + np.uint32(length)).astype(np.uint32).tobytes(),
                    anchor[at].tobytes() if kind >= 0 else b"",
                ))
        return pa.Table.from_batches([batch_of(out, SPANS)])

    return run


TEXTS = pa.schema([("shard", pa.int64()), ("docs", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())])


def spans_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (joined(table.column("docs"), np.int64), joined(table.column("starts"), np.uint32).astype(np.int64),
            joined(table.column("ends"), np.uint32).astype(np.int64))


def fetch_task(fragments: int) -> Callable:
    """One block of documents: cut out the texts that shards must sort."""

    def run(key: tuple, docs: pa.Table, spans: pa.Table) -> pa.Table:
        doc, start, end = spans_of(spans)
        counts = np.diff(binary_column(spans.column("docs"))[1]) // 8
        group = np.repeat(spans.column("group").to_numpy(), counts)
        rows = []
        if len(doc):
            ids = docs.column("doc_id").to_numpy()
            data, offsets = binary_column(docs.column("text"))
            by_id = np.argsort(ids, kind="stable")
            place = by_id[np.searchsorted(ids[by_id], doc)]
            a = offsets[place] + start
            size = end - start
            order = np.argsort(group, kind="stable")
            cut = np.r_[run_starts(group[order]), len(order)]
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                at = order[x:y]
                spots = np.repeat(a[at] - np.r_[0, np.cumsum(size[at])[:-1]], size[at]) + np.arange(size[at].sum())
                rows.append((int(group[at[0]]), doc[at].tobytes(), start[at].tobytes(), size[at].tobytes(), data[spots].tobytes()))
        return pa.Table.from_batches([batch_of(rows, TEXTS)])

    return run


def window_hashes(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window, text by text; where each text's windows start, and the end)."""
    cut = np.r_[0, np.cumsum(np.maximum(np.diff(offsets) - length + 1, 0))]
    hashes, hasher, first = np.empty(cut[-1], np.uint64), SpanHasher(), 0
    while first < len(cut) - 1:  # texts of about ``STRIP`` bytes at once
        last = max(int(np.searchsorted(offsets, offsets[first] + STRIP, side="right")) - 1, first + 1)
        windows = np.diff(cut[first : last + 1])
        start = np.arange(cut[last] - cut[first]) + np.repeat(offsets[first:last] - offsets[first] - cut[first:last] + cut[first], windows)
        prefix = hasher.prefix(raw[offsets[first] : offsets[last]])
        hashes[cut[first] : cut[last]] = hasher.spans(prefix, start, start + length)
        first = last
    return hashes, cut


def may_repeat(raw: np.ndarray, offsets: np.ndarray, document: np.ndarray, length: int) -> np.ndarray:
    """Texts with a window whose hash occurs in another document, too."""
    hashes, cut = window_hashes(raw, offsets, length)
    hit = np.r_[0, np.cumsum(several(hashes, np.repeat(document, np.diff(cut))))]
    return hit[cut[1:]] > hit[cut[:-1]]


def repeated_parts(raw: np.ndarray, offsets: np.ndarray, document: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, hash of the first, hash of the last) of the maximal runs
    of windows whose hash occurs in another document, too."""
    hashes, cut = window_hashes(raw, offsets, length)
    hit = several(hashes, np.repeat(document, np.diff(cut)))
    new, ends = hit.copy(), hit.copy()
    new[1:] &= ~hit[:-1]
    ends[:-1] &= ~hit[1:]
    edge = cut[1:-1][(cut[1:-1] > 0) & (cut[1:-1] < len(hit))]
    new[edge], ends[edge - 1] = hit[edge], hit[edge - 1]
    begin, end = np.flatnonzero(new), np.flatnonzero(ends)
    text = np.searchsorted(cut, begin, side="right") - 1
    return text, begin - cut[text], end - cut[text], hashes[begin], hashes[end]


def taken(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of spans of ``raw``, one after the other."""
    return raw[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


def shard_task(blocks: int, length: int, gram: int) -> Callable:
    """One shard of texts: the windows that a document with a smaller id holds, too.

    Of a text only the parts count whose windows may repeat. Parts of the same bytes are one:
    they go whole from all documents but the smallest, whose part is sorted with the others. A text
    has fewer windows than a window has bytes, so its first and last one hold all of it.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        doc = joined(table.column("docs"), np.int64)
        start, size = joined(table.column("starts"), np.int64), joined(table.column("sizes"), np.int64)
        raw, _ = binary_column(table.column("bytes"))
        offsets = np.r_[0, np.cumsum(size)]
        text, first, last, *ends = repeated_parts(raw, offsets, doc, length)
        who, count = doc[text], last - first + length
        order = np.lexsort((who, count, *ends))
        text, first, who, count = (c[order] for c in (text, first, who, count))
        own = run_starts(count, *(c[order] for c in ends))
        members = np.diff(np.r_[own, len(order)])
        whole = who > np.repeat(who[own], members)
        # The smallest document may hold a part several times: it is sorted once.
        least = np.add.reduceat((~whole).astype(np.int64), own) if len(own) else own
        place, n = offsets[text[own]] + first[own], count[own]
        chosen = np.flatnonzero(may_repeat(taken(raw, place, n), np.r_[0, np.cumsum(n)], who[own], length))
        place, n = place[chosen], n[chosen]
        part, window = covered_windows(taken(raw, place, n), np.r_[0, np.cumsum(n)], who[own[chosen]], length)
        order = np.lexsort((window, part))
        part, window = part[order], window[order]
        fresh = np.ones(len(part), bool)
        fresh[1:] = (part[1:] != part[:-1]) | (window[1:] != window[:-1] + 1)
        until = window[np.r_[fresh[1:], True][: len(part)]] + length
        part, window = chosen[part[fresh]], window[fresh]
        copies = least[part]
        at = np.repeat(own[part] - np.cumsum(copies) + copies, copies) + np.arange(int(copies.sum()))
        at, low, high = (np.r_[a, b] for a, b in zip(
            (np.flatnonzero(whole), np.zeros(int(whole.sum()), np.int64), count[whole]),
            (at, np.repeat(window, copies), np.repeat(until, copies)), strict=True))
        who, base = who[at], start[text[at]] + first[at]
        order, found, cut = by_key(who % blocks)
        out = [(int(f), -1, who[i].tobytes(), (base + low)[i].astype(np.uint32).tobytes(), (base + high)[i].astype(np.uint32).tobytes(), b"")
               for f, i in zip(found, np.split(order, cut[1:-1]), strict=False)]
        return pa.Table.from_batches([batch_of(out, SPANS)])

    return run


KEPT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def keep_task(with_text: bool) -> Callable:
    """One block of documents: take the removed bytes out."""

    def run(key: tuple, docs: pa.Table, spans: pa.Table) -> pa.Table:
        doc, start, end = spans_of(spans)
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        ids = docs.column("doc_id").to_numpy()
        data, offsets = binary_column(docs.column("text"))
        low, high = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
        columns: list[list] = [[] for _ in range(5)]
        for i in range(len(ids)):
            raw = data[offsets[i] : offsets[i + 1]]
            removed = spans_count = 0
            kept = raw
            if high[i] > low[i]:
                step = np.zeros(len(raw) + 1, np.int64)
                np.add.at(step, np.minimum(start[low[i] : high[i]], len(raw)), 1)
                np.add.at(step, np.minimum(end[low[i] : high[i]], len(raw)), -1)
                gone = np.cumsum(step[:-1]) > 0
                removed = int(gone.sum())
                spans_count = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]]))
                kept = raw[~gone]
            body = kept.tobytes()
            for c, v in zip(columns, (len(raw), removed, spans_count, hashlib.sha256(body).hexdigest(), body), strict=True):
                c.append(v)
        arrays = [docs.column("doc_id"), *(pa.array(c[:], pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            arrays.append(pa.array([c.decode("utf-8", "ignore") for c in columns[4]], pa.string()))
            names.append("kept_text")
        return pa.Table.from_arrays(arrays, names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts in a document
    with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with
    ``with_text``, kept_text (the remaining bytes as text, without cut characters). Texts are UTF-8
    bytes; null counts as empty. Matches never cross documents, and repeats inside one
    document stay. Rows that share a doc_id are one document to the rule and are all judged
    by it as first read; doc_id must be unique for spans to be exact, rows with a null doc_id
    are left out. Other columns are ignored; an empty table gives an empty result.
    """
    fragments = 4 * partitions(docs)
    blocks = fragments
    rows = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    dealt = rows.mapInArrow(run_task(fragments, length, gram), RUNS_SQL)
    spans, _ = stage(dealt.groupBy("frag").applyInArrow(fragment_task(fragments, blocks, length), SPANS_SQL), "spans")
    by_block = rows.withColumn("block", F.pmod("doc_id", F.lit(blocks)).cast("int"))
    texts = by_block.groupBy("block").cogroup(spans.where("group >= 0").groupBy("block")).applyInArrow(
        fetch_task(fragments), "shard long, docs binary, starts binary, sizes binary, bytes binary")
    found = texts.groupBy("shard").applyInArrow(shard_task(blocks, length, gram), SPANS_SQL)
    found, _ = stage(found, "found")
    every = spans.where("group < 0").union(found)
    schema = KEPT_SQL + (", kept_text string" if with_text else "")
    return by_block.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(keep_task(with_text), schema)
