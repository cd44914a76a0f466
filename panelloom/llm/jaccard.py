"""Near duplicates by word n-grams: an exact Jaccard join by vertical partitioning.

Global order. Shingles are ordered by document frequency, then by hash. Two sets with a
Jaccard similarity of t share a shingle among the first n - ceil(t n) + 1 of either set, so
only these *prefixes* are looked up, and rare shingles come first.

Fragments. The order is cut into fragments twice. To count frequencies, tasks deal packed
arrays (hashes and the set each belongs to) to fragments of the hash space; a fragment keeps
what at least two different sets share, all the rest can add nothing to an overlap. A set is
named once for all its shingles in a fragment and its size travels once, so there are only as
many fragments as input partitions; a fragment is counted one slice of hashes at a time. To count
overlaps, the shared shingles of a set are cut into ``FRAGMENTS`` segments, the partial
overlaps of each candidate pair are counted segment by segment and summed per pair.

Equal sets are one *class* from the first task on, so exact copies are never paired. Links
inside a group that is already connected need no check: candidates are first compared with
one partner, then ``STARS`` times with one partner for each shared shingle, and only pairs that are still in
different groups are enumerated in full, each pair once, at its first shared shingle, and only
where enough of both sets is left behind it to reach the overlap that their sizes need. So a group of near copies costs about as many pairs
as it has members, and no link between different groups is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    SpanHasher, binary_column, by_key, chunks, components, discard, joined, mix, partitions, run_starts, stage,
)

WORDS = 5
THRESHOLD = (3, 4)  # similarity 0.75 as a fraction
FRAGMENTS = 4
STARS = 2  # turns of one partner for each shared shingle
FLUSH = 1_000_000  # shingles a task gathers before it deals them

# ASCII rules of the word pattern (fixed values).
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

PACKED = "frag int, docs boolean, keys binary, sets binary, sizes binary, runs binary"
PACKED_ARROW = pa.schema([
    ("frag", pa.int32()), ("docs", pa.bool_()), ("keys", pa.binary()), ("sets", pa.binary()),
    ("sizes", pa.binary()), ("runs", pa.binary()),
])


class Shingles:
    """Distinct shingle hashes of many documents at once."""

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        self.hasher = SpanHasher()
        self.place = mix(np.arange(1, words + 2, dtype=np.uint64)) | np.uint64(1)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash), sorted, each pair once."""
        k, n = self.words, len(data)
        inside = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(inside & (~np.r_[False, inside[:-1]] | edge[:-1])) if n else np.empty(0, np.int64)
        end = np.flatnonzero(inside & (~np.r_[inside[1:], False] | edge[1:])) + 1 if n else start
        word = self.hasher.spans(self.hasher.prefix(LOWER[data]), start, end)
        document = np.searchsorted(offsets, start, side="right") - 1
        rows = len(offsets) - 1
        first = np.searchsorted(document, np.arange(rows + 1))
        count = np.diff(first)
        out_doc, out_hash = [], []
        if len(word) >= k:
            total = np.zeros(len(word) - k + 1, np.uint64)
            for j in range(k):
                total += word[j : j + len(total)] * self.place[j]
            whole = document[: len(total)] == document[k - 1 :]
            out_doc.append(document[: len(total)][whole])
            out_hash.append(mix(total[whole]))
        for length in range(1, k):  # short documents: the whole sequence
            at = np.flatnonzero(count == length)
            if len(at):
                total = np.full(len(at), self.place[k], np.uint64) * np.uint64(length)
                for j in range(length):
                    total += word[first[at] + j] * self.place[j]
                out_doc.append(at)
                out_hash.append(mix(total))
        if not out_doc:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        doc, hashes = np.concatenate(out_doc), np.concatenate(out_hash)
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        keep = run_starts(doc, hashes)
        return doc[keep], hashes[keep]


LONGEST_RUN = 255  # of one set in a packed row; longer ones are cut up


def cut_runs(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs cut to ``LONGEST_RUN``: the number of each piece's run, and its length as a byte."""
    pieces = -(-run // LONGEST_RUN)
    length = np.full(int(pieces.sum()), LONGEST_RUN, np.uint8)
    length[np.cumsum(pieces) - 1] = run - LONGEST_RUN * (pieces - 1)
    return np.repeat(np.arange(len(run)), pieces), length


def deal(doc_sets: np.ndarray, sizes: np.ndarray, doc: np.ndarray, hashes: np.ndarray, fragments: int) -> list[tuple]:
    """Packed rows of one task: per fragment the hashes (4 bytes of each, then 1 of each), and
    runs of the sets they belong to; and the sizes of the sets, by block, on the negative side."""
    fragment = ((hashes >> np.uint64(32)) % np.uint64(fragments)).astype(np.int32)
    order, found, cut = by_key(fragment)
    out = []
    for i, f in enumerate(found):
        at = order[cut[i] : cut[i + 1]]
        owner = doc[at]
        begin = run_starts(owner)
        piece, run = cut_runs(np.diff(np.r_[begin, len(owner)]))
        low, high = hashes[at].astype(np.uint32), (hashes[at] >> np.uint64(56)).astype(np.uint8)
        out.append((int(f), False, low.tobytes() + high.tobytes(), doc_sets[owner[begin][piece]].tobytes(), b"", run.tobytes()))
    held = doc[run_starts(doc)]
    order, blocks, cut = by_key((doc_sets[held] % np.uint64(fragments)).astype(np.int32))
    for i, b in enumerate(blocks):
        who = held[order[cut[i] : cut[i + 1]]]
        out.append((-1 - int(b), False, b"", doc_sets[who].tobytes(), sizes[who].astype(np.int32).tobytes(),
                    np.zeros(len(who), np.int32).tobytes()))
    return out


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def shingle_task(words: int, fragments: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(words)
        held: list[tuple] = []
        seen: np.ndarray = np.empty(0, np.uint64)

        def flush() -> list[tuple]:
            sets = np.concatenate([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            shift = np.cumsum([0, *(len(h[0]) for h in held)])
            doc = np.concatenate([h[2] + s for h, s in zip(held, shift, strict=False)])
            hashes = np.concatenate([h[3] for h in held])
            held.clear()
            return deal(sets, sizes, doc, hashes, fragments)

        for number, batch in enumerate(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = binary_column(batch.column("text"))
            info: list[np.ndarray] = []
            for part, raw, cut in chunks(ids, data, offsets):
                doc, hashes = make.of(raw, cut)
                sizes = np.bincount(doc, minlength=len(part))
                sets = np.zeros(len(part), np.uint64)
                np.add.at(sets, doc, mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
                sets = mix(sets + sizes.astype(np.uint64))
                info.append(np.stack([part.astype(np.int64), sizes, sets.view(np.int64)], axis=1))
                # A set that this task has dealt already is not dealt again.
                fresh = np.zeros(len(part), bool)
                fresh[np.unique(sets, return_index=True)[1]] = True
                fresh &= ~np.isin(sets, seen) & (sizes > 0)
                seen = np.union1d(seen, sets[fresh])
                keep = fresh[doc]
                held.append((sets, sizes, doc[keep], hashes[keep]))
                if sum(len(h[3]) for h in held) >= FLUSH:
                    yield to_batch(flush(), PACKED_ARROW)
            if info:
                rows = np.concatenate(info)
                yield to_batch([(-1 - (number * 7919 + int(abs(rows[0, 0]))) % fragments, True, rows.tobytes(), b"", b"", b"")], PACKED_ARROW)
        if held:
            yield to_batch(flush(), PACKED_ARROW)

    return run


def share_task(fragments: int) -> Callable:
    """One fragment: keep the shingles of at least two sets, with their frequencies.

    Sizes and documents pass, the sizes to their block.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        fragment = key[0].as_py()
        if fragment < 0:
            frag = pa.array(np.where(table.column("docs").to_numpy(), fragment, -1 - fragment).astype(np.int32))
            return table.select([f.name for f in PACKED_ARROW]).set_column(0, "frag", frag)
        low, high = [], []
        data, offsets = binary_column(table.column("keys"))
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            n = (b - a) // 5
            low.append(np.frombuffer(data[a : a + 4 * n].tobytes(), np.uint32))
            high.append(data[a + 4 * n : b])
        low, high = np.concatenate(low), np.concatenate(high)
        known, number = np.unique(joined(table.column("sets"), np.uint64), return_inverse=True)
        owner = np.repeat(number.astype(np.uint32), joined(table.column("runs"), np.uint8))
        order = np.argsort(high, kind="stable")
        edge = np.searchsorted(high[order], np.arange(257))
        kept: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32))]
        for part in range(256):  # a slice of the fragment's hashes
            at = order[edge[part] : edge[part + 1]]
            both = np.unique((low[at].astype(np.uint64) << np.uint64(32)) | owner[at])  # a set counts once
            key_of = both >> np.uint64(32)
            frequency = np.diff(np.r_[run_starts(key_of), len(key_of)])
            often = np.repeat(frequency, frequency)
            keep = often > 1
            kept.append((
                (both[keep] & np.uint64(0xFFFFFFFF)).astype(np.int64),
                (np.uint64(fragment << 40 | part << 32)) | key_of[keep],
                np.minimum(often[keep], np.iinfo(np.int32).max).astype(np.int32),
            ))
        who, value, often = (np.concatenate(c) for c in zip(*kept, strict=True))
        block = (known % np.uint64(fragments)).astype(np.int64)[who]
        order = np.lexsort((who, block))
        block, who, value, often = block[order], who[order], value[order], often[order]
        out = []
        cut = np.r_[run_starts(block), len(block)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            begin = run_starts(who[a:b])
            out.append((int(block[a]), False, value[a:b].tobytes() + often[a:b].tobytes(), known[who[a:b][begin]].tobytes(),
                        np.zeros(len(begin), np.int32).tobytes(), np.diff(np.r_[begin, b - a]).astype(np.int32).tobytes()))
        return pa.Table.from_batches([to_batch(out, PACKED_ARROW)])

    return run


ALIVE = pa.schema([("cls", pa.int64()), ("n", pa.int32()), ("ahead", pa.int32()), ("prefix", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64()))])


def prefix_task(threshold: tuple[int, int]) -> Callable:
    """One block of sets: drop those that cannot reach the threshold, order the others."""
    top, bottom = threshold

    def run(key: tuple, table: pa.Table) -> pa.Table:
        value, often = [], []
        data, offsets = binary_column(table.column("keys"))
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            n = (b - a) // 12
            raw = data[a:b].tobytes()
            value.append(np.frombuffer(raw[: 8 * n], np.uint64))
            often.append(np.frombuffer(raw[8 * n :], np.int32))
        value, often = np.concatenate(value), np.concatenate(often)
        run_set, run_size = joined(table.column("sets"), np.uint64), joined(table.column("sizes"), np.int32)
        known, number = np.unique(run_set, return_inverse=True)
        size_of = np.zeros(len(known), np.int64)
        np.maximum.at(size_of, number, run_size)  # rows of shingles have no sizes
        owner = np.repeat(number, joined(table.column("runs"), np.int32))
        order = np.lexsort((value, often, owner))
        owner, value = owner[order], value[order]
        cut = np.searchsorted(owner, np.arange(len(known) + 1))
        have = np.diff(cut)
        need = -(-size_of * top // bottom)
        alive = np.flatnonzero(have >= need)
        # Unshared shingles are rarer than all shared ones: they fill the prefix first.
        take = (size_of - need + 1 - (size_of - have))[alive]
        return pa.Table.from_arrays([
            pa.array(known[alive].view(np.int64)), pa.array(size_of[alive].astype(np.int32)),
            pa.array((size_of - have)[alive].astype(np.int32)),
            pa.array([value[cut[c] : cut[c] + t].view(np.int64) for c, t in zip(alive, take, strict=True)], pa.list_(pa.int64())),
            pa.array([np.sort(value[cut[c] : cut[c + 1]]).view(np.int64) for c in alive], pa.list_(pa.int64())),
        ], schema=ALIVE)

    return run


def unpack_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = joined(batch.column("keys"), np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)], ["doc_id", "n_shingles", "cls"])


def verified(pairs: DataFrame, segments: DataFrame, threshold: tuple[int, int]) -> tuple[DataFrame, str]:
    """Pairs (a, b, na, nb) that reach the threshold: partial overlaps summed per pair.

    The candidates are written first: Spark then knows their size and moves the segments
    only where the candidates are too many to be sent to them.
    """
    top, bottom = threshold
    pairs, path = stage(pairs, "pairs")
    left = segments.select(F.col("cls").alias("a"), F.col("segments").alias("x"))
    right = segments.select(F.col("cls").alias("b"), F.col("segments").alias("y"))
    partial = F.zip_with("x", "y", lambda x, y: F.size(F.array_intersect(x, y)))
    total = pairs.join(left, "a").join(right, "b").select(
        "a", "b", "na", "nb", F.aggregate(partial, F.lit(0), lambda s, v: s + v).alias("both"))
    close = total.where(bottom * F.col("both") >= top * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")
    links, links_path = stage(close, "links")
    discard(pairs.sparkSession, path)
    return links, links_path


def first_shared(labelled: DataFrame, alive: DataFrame, fits: str) -> DataFrame:
    """Every pair of different groups that shares a shingle, made at the first one only.

    Each row carries the shingles of its set before this one; a pair whose sets share one of
    these has been made there. A pair that can be a link fits at its first shared shingle.
    """
    before = alive.select("cls", "prefix")
    rows = labelled.join(before, "cls").withColumn("before", F.slice("prefix", F.lit(1), F.col("at"))).drop("prefix", "at")
    names = {"root": "other", "cls": "a", "n": "na", "left": "la", "before": "earlier"}
    found = rows.join(rows.select("token", *[F.col(c).alias(d) for c, d in names.items()]), "token")
    found = found.where("root <> other AND a < cls").where(fits).where(~F.arrays_overlap("before", "earlier"))
    return found.select("a", F.col("cls").alias("b"), "na", F.col("n").alias("nb"))


def ngram_groups(docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD,
                 fragments: int | None = None) -> DataFrame:
    """Groups of documents linked by similar shingle sets.

    Returns one row per input row: doc_id, n_shingles, component_id (the smallest doc_id
    reachable by links). Words are runs of other characters than ASCII white space, A-Z
    lower-cased; a text with fewer than ``words`` words is one shingle; null, empty and blank
    texts have none and link with nothing. Repeated rows are exact copies; a repeated doc_id
    with other text is a further member. Other columns are ignored; an empty table gives an
    empty result. Sets are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
    ).where("doc_id IS NOT NULL")
    fragments = fragments or partitions(rows)
    packed = rows.mapInArrow(shingle_task(words, fragments), PACKED)
    shared, shared_path = stage(packed.groupBy("frag").applyInArrow(share_task(fragments), PACKED), "shared")
    members = shared.where("docs").select("keys").mapInArrow(unpack_docs, "doc_id long, n_shingles long, cls long")
    members, members_path = stage(members, "members")
    alive, alive_path = stage(
        shared.where("NOT docs").groupBy("frag").applyInArrow(
            prefix_task(threshold), "cls long, n int, ahead int, prefix array<long>, shared array<long>"), "alive")
    discard(spark, shared_path)
    cut = [F.expr(f"filter(shared, v -> pmod(v, {FRAGMENTS}) = {i})") for i in range(FRAGMENTS)]
    segments = alive.select("cls", F.array(*cut).alias("segments"))
    # left: shingles of the set from this one on, itself included, in the global order.
    tokens = alive.select("cls", "n", "ahead", F.posexplode("prefix").alias("at", "token")).select(
        "cls", "n", "token", "at", (F.col("n") - F.col("ahead") - F.col("at")).alias("left"))
    rare = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("token")
    tokens, tokens_path = stage(tokens.join(rare, "token", "left_semi"), "tokens")
    top, bottom = threshold
    # Sizes are close enough, and what is left of either set from the shared shingle on can
    # still hold the overlap that the two sizes need. The first shared shingle passes this.
    fits = (f"least(na, n) * {bottom} >= greatest(na, n) * {top}"
            f" AND least(left, la) * {top + bottom} >= (n + na) * {top}")
    partner = [F.col("cls").alias("a"), F.col("n").alias("na"), F.col("left").alias("la")]

    def paired(rows: DataFrame, partners: DataFrame, other: str) -> DataFrame:
        found = rows.join(partners, "token").where(other).where(fits)
        return found.select("a", F.col("cls").alias("b"), "na", F.col("n").alias("nb")).distinct()

    # First one partner per set, then one for each shared shingle, then all that is left.
    pivots = tokens.groupBy("token").agg(F.min(F.struct(*partner)).alias("p")).select("token", "p.*")
    one = paired(tokens, pivots, "a <> cls").groupBy("b", "nb").agg(F.min(F.struct("a", "na")).alias("p")).select("p.*", "b", "nb")
    links, links_path = verified(one, segments, threshold)
    paths = [members_path, alive_path, tokens_path, links_path]
    for turn in range(STARS + 1):
        groups = components(links)
        labelled = tokens.join(groups.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn(
            "root", F.coalesce("root", "cls"))
        open_tokens = labelled.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        labelled = labelled.join(open_tokens.select("token"), "token", "left_semi")
        others = labelled.select("token", F.col("root").alias("other"), *partner)
        if turn == STARS:
            pairs = first_shared(labelled, alive, fits)
        else:
            # A member of the smallest group, another one for each shingle and turn.
            draw = F.xxhash64(F.lit(turn), "token", "a")
            pivots = others.groupBy("token").agg(F.min(F.struct("other", draw, "a", "na", "la")).alias("p"))
            pairs = paired(labelled, pivots.select("token", "p.other", "p.a", "p.na", "p.la"), "root <> other")
        more, more_path = verified(pairs, segments, threshold)
        paths.append(more_path)
        links = links.union(more)
    groups = components(links)
    of_class = members.groupBy("cls").agg(F.min("doc_id").alias("low"))
    named = groups.join(of_class, groups["node"] == of_class["cls"]).select("node", "root", "low")
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    named = named.join(lowest, "root").select(F.col("node").alias("cls"), "component")
    classes = of_class.join(named, "cls", "left").select("cls", F.coalesce("component", "low").alias("class_component"))
    out = members.join(classes, "cls").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("class_component")).alias("component_id"),
    )
    out, _ = stage(out, "ngram-groups")
    discard(spark, *paths)
    return out
