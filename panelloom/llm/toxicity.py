"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is trained in numpy from confirmed toxic documents and
unlabelled ones. With the share p of toxic documents known, the risk of the unseen negatives
is the risk of "negative" over unlabelled text minus p times the same risk over the confirmed
ones; when that difference turns negative in a batch (the classifier overfits), the step
climbs it back instead of following it (non-negative estimator).

The training rows are a bounded sample: at most ``positives`` confirmed and ``unlabelled``
other documents, the ones with the smallest hash of their id. Document frequencies, which
weigh the words, are counted over all training documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, binary_column, chunks, joined, run_starts

BITS = 18  # words are hashed into 2^BITS cells
STEM_BYTES = 6


@dataclass(frozen=True)
class PuSettings:
    positives: int = 6_000
    unlabelled: int = 18_000
    epochs: int = 30
    batches: int = 24
    step: float = 0.02
    decay: float = 1e-4
    least: int = 5
    border: float = 4.5
    seed: int = 7


LETTERS = np.zeros(256, bool)
LETTERS[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1),
         *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class WordCells:
    """Distinct hashed words and word beginnings of many documents, with log counts."""

    def __init__(self) -> None:
        self.hasher = SpanHasher()

    def cells(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, cell, weight) sorted by document; words are runs of letters and digits."""
        n = len(data)
        inside = LETTERS[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.r_[False, inside[:-1]] if n else np.empty(0, bool)
        start = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.r_[inside[1:], False] if n else np.empty(0, bool)
        end = np.flatnonzero(inside & (~after | first[1:])) + 1
        prefix = self.hasher.prefix(LOWER[data])
        document = np.searchsorted(offsets, start, side="right") - 1
        # Long words also count by their beginning, whatever their ending.
        long = end - start > STEM_BYTES
        stem = self.hasher.spans(prefix, start[long], start[long] + STEM_BYTES) ^ np.uint64(1 << 63)
        word = np.r_[self.hasher.spans(prefix, start, end), stem]
        word = (word >> np.uint64(64 - BITS)).astype(np.int64)
        document = np.r_[document, document[long]]
        key = np.sort((document << BITS) | word)
        begin = run_starts(key)
        count = np.diff(np.r_[begin, len(key)])
        return key[begin] >> BITS, key[begin] & ((1 << BITS) - 1), (1 + np.log(count)).astype(np.float32)


def batch_cells(batch: pa.RecordBatch, words: WordCells) -> Iterator[tuple[int, int, tuple]]:
    data, offsets = binary_column(batch.column("text"))
    first = 0
    for ids, part, cut in chunks(np.arange(batch.num_rows), data, offsets):
        yield first, len(ids), words.cells(part, cut)
        first += len(ids)


def frequency_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, total = WordCells(), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for _, _, (_, cell, _) in batch_cells(batch, words):
            total += np.bincount(cell, minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])


def feature_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordCells()
    for batch in batches:
        cells, weights = [], []
        for _, rows, (document, cell, weight) in batch_cells(batch, words):
            cut = np.searchsorted(document, np.arange(rows + 1))
            cells += [cell[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            weights += [weight[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array(cells, pa.binary()), pa.array(weights, pa.binary())],
            ["toxic", "cells", "weights"],
        )


class Rows:
    """Sparse rows of weighted cells."""

    def __init__(self, document: np.ndarray, cell: np.ndarray, value: np.ndarray, n: int) -> None:
        self.document, self.cell, self.value, self.n = document, cell, value, n
        self.cut = np.searchsorted(document, np.arange(n + 1))

    @classmethod
    def scaled(cls, document: np.ndarray, cell: np.ndarray, weight: np.ndarray, n: int, rarity: np.ndarray) -> Rows:
        kept = rarity[cell] > 0
        document, cell = document[kept], cell[kept]
        return cls(document, cell, (weight[kept] * rarity[cell]).astype(np.float32), n)

    def only(self, keep: np.ndarray) -> Rows:
        rows = np.flatnonzero(keep)
        document, cell, value = self.pick(rows)
        return Rows(document, cell, value, len(rows))

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = self.cut[rows + 1] - self.cut[rows]
        at = np.repeat(self.cut[rows] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        return np.repeat(np.arange(len(rows)), size), self.cell[at], self.value[at]

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.document, self.value * weights[self.cell], minlength=self.n) + bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train_pu(positive: Rows, unlabelled: Rows, prior: float, s: PuSettings) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative risk estimator (logistic loss, Adam steps)."""
    rng = np.random.default_rng(s.seed)
    size = 1 << BITS
    w, bias = np.zeros(size), 0.0
    m, v, mb, vb, t = np.zeros(size), np.zeros(size), 0.0, 0.0, 0
    for _ in range(s.epochs):
        ps = np.array_split(rng.permutation(positive.n), s.batches)
        us = np.array_split(rng.permutation(unlabelled.n), s.batches)
        for p, u in zip(ps, us, strict=True):
            if not len(p) or not len(u):
                continue
            grad, gb = np.zeros(size), 0.0
            dp, cp, xp = positive.pick(p)
            du, cu, xu = unlabelled.pick(u)
            fp = np.bincount(dp, xp * w[cp], minlength=len(p)) + bias
            fu = np.bincount(du, xu * w[cu], minlength=len(u)) + bias
            # softplus(f) is the loss of calling a row negative, softplus(-f) positive.
            rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            gp_negative = prior * sigmoid(fp) / len(p)
            gu_negative = sigmoid(fu) / len(u)
            if rest >= 0:
                row_p = -prior * sigmoid(-fp) / len(p) - gp_negative
                row_u = gu_negative
            else:
                row_p, row_u = gp_negative, -gu_negative
            grad += np.bincount(cp, row_p[dp] * xp, minlength=size)
            grad += np.bincount(cu, row_u[du] * xu, minlength=size)
            gb = row_p.sum() + row_u.sum()
            grad += s.decay * w
            t += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            scale = s.step * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            w -= scale * m / (np.sqrt(v) + 1e-8)
            bias -= scale * mb / (np.sqrt(vb) + 1e-8)
    return w, bias


def telling(positive: pa.Table, unlabelled: pa.Table, counts: np.ndarray, s: PuSettings) -> np.ndarray:
    """Weight 0..1 of each cell: how far its shares in the two samples lie apart.

    Cells seen in fewer than ``least`` training documents, or whose shares differ by less
    than ``border`` standard errors, get 0.
    """
    p, u = (sum(np.bincount(joined(c, np.int32), minlength=1 << BITS) for c in side.column("cells").chunks) / side.num_rows
            for side in (positive, unlabelled))
    both = (p * positive.num_rows + u * unlabelled.num_rows + 1) / (positive.num_rows + unlabelled.num_rows + 2)
    error = np.sqrt(both * (1 - both) * (1 / positive.num_rows + 1 / unlabelled.num_rows))
    z = np.abs(p - u) / error
    z[counts < s.least] = 0
    return np.where(z > s.border, np.minimum(z / 20, 1), 0).astype(np.float32)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # 2^BITS
    rarity: np.ndarray  # 2^BITS
    bias: float


def fit_toxicity(docs: DataFrame, labels: DataFrame, settings: PuSettings = PuSettings()) -> ToxicityModel:
    """Train from the training documents and the labels of these documents.

    Labels are (doc_id, toxic); null labels, labels without a document and conflicting
    repeats (the larger counts) are allowed. The prior is the share of toxic rows among the
    labelled ones. Without a toxic label the model scores everything 0.
    """
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    cells = texts.select("text").mapInArrow(frequency_task, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << BITS)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.float64)
    known = texts.select("doc_id").join(marks, "doc_id", "left")
    total = known.agg(
        F.count(F.lit(1)).alias("n"), F.count("toxic").alias("labelled"),
        F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("positive"),
    ).first()
    rarity = np.log((1 + total["n"]) / (1 + counts)).astype(np.float32)
    free = total["n"] - total["labelled"]
    if not total["positive"] or not total["n"]:
        return ToxicityModel(np.zeros(1 << BITS), rarity, -30.0)
    prior = min(max(total["positive"] / total["labelled"], 1e-4), 0.9)
    # Where nothing is left without a label, the labelled rows stand in for unlabelled text.
    as_unlabelled = F.col("toxic").isNull() if free >= 100 else F.col("toxic").isNull() | (F.col("toxic") != 1)
    pool = free if free >= 100 else total["n"] - total["positive"]
    rank = F.pmod(F.xxhash64(F.lit(settings.seed), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # The expected size stays a tenth below the bound; the limit holds it in any case.
    # Only ids meet the labels; the few chosen ones then go to the texts.
    chosen = known.select("doc_id", F.when((F.col("toxic") == 1) & (rank < 0.9 * settings.positives / total["positive"]), 1).when(
        as_unlabelled & (rank < 0.9 * settings.unlabelled / max(pool, 1)), 0).alias("toxic")).where("toxic IS NOT NULL").distinct()
    picked = texts.alias("t").join(F.broadcast(chosen.alias("c")), F.col("t.doc_id").eqNullSafe(F.col("c.doc_id"))).select("toxic", "text")
    sample = picked.where("toxic = 1").limit(settings.positives).union(picked.where("toxic = 0").limit(settings.unlabelled))
    rows = sample.mapInArrow(feature_task, "toxic int, cells binary, weights binary").toArrow()
    kinds = rows.column("toxic").to_numpy()
    sides = [rows.filter(pa.array(kinds == kind)) for kind in (1, 0)]
    del rows
    if not sides[0].num_rows or not sides[1].num_rows:
        return ToxicityModel(np.zeros(1 << BITS), rarity, -30.0)
    rarity = rarity * telling(*sides, counts, settings)

    def part(chosen: pa.Table) -> Rows:
        """Rows of the telling cells, chunk by chunk: the driver never holds the others unpacked."""
        parts, n = [], 0
        for batch in chosen.to_batches():
            size = np.diff(binary_column(batch.column("cells"))[1]) // 4
            held = Rows.scaled(np.repeat(np.arange(len(size)), size), joined(batch.column("cells"), np.int32),
                               joined(batch.column("weights"), np.float32), len(size), rarity)
            parts.append((held.document + n, held.cell, held.value))
            n += len(size)
        return Rows(*(np.concatenate(c) for c in zip(*parts, strict=True)), n)

    positive, unlabelled = part(sides[0]), part(sides[1])
    del sides
    learn = np.arange(unlabelled.n) % 3 > 0 if unlabelled.n >= 300 else np.ones(unlabelled.n, bool)
    weights, bias = train_pu(positive, unlabelled.only(learn), prior, settings)
    # Move the border so that the share called toxic among unlabelled text that was not
    # trained on is the prior.
    ordered = np.sort(unlabelled.only(~learn if not learn.all() else learn).scores(weights, bias))[::-1]
    k = min(max(int(round(prior * len(ordered))), 1), len(ordered) - 1) if len(ordered) > 1 else 0
    border = (ordered[k] + ordered[k - 1]) / 2 if k else ordered[0]
    return ToxicityModel(weights, rarity, float(bias - border))


def score_task(model_of: Callable[[], tuple]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, rarity, bias = model_of()
        words = WordCells()
        for batch in batches:
            out = [np.empty(0)]
            for _, rows, (document, cell, weight) in batch_cells(batch, words):
                out.append(Rows.scaled(document, cell, weight, rows, rarity).scores(weights, bias))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sigmoid(np.concatenate(out)))], ["doc_id", "score"]
            )

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Score every row's whole ``text``: doc_id, score in 0..1, predicted (score >= 0.5).

    Only the text is read. Null and empty texts get the score of a text without words.
    Repeated rows stay, other columns are ignored, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.rarity, model.bias))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(score_task(lambda: shared.value), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
