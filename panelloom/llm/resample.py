"""Importance resampling towards a target: array-scored weights, quantile-sketch bracketing.

1. Both corpora are hashed into one array of feature counts: tasks fold their documents into
   dense arrays, Spark adds the arrays' entries. The arrays have ``buckets`` entries whatever
   the corpus, so they are the only thing the driver sees.
2. A document's weight is a gather from the array of gains, summed over its features. A
   seeded Gumbel noise on top turns "the k highest" into a draw without replacement.
3. The k-th highest score is bracketed by a quantile sketch. Exact counts outside the bracket
   validate it, a bracket that misses is widened, and only rows inside are sorted. The rows
   above the cutoff are then numbered by ranges.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, binary_column, chunks, discard, numbered, stage, word_spans

BUCKETS = 10_000
# Bytes of words: digits, letters and whatever is not ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
# Words beyond this length are hashed one by one.
LONG_WORD = 64
SKETCH_SIZE = 4_000
# Half-width of the first bracket as a share of the rows; a miss makes it eight times wider.
BRACKET = 0.004
ALL_BITS = np.uint32(0xFFFFFFFF)


def crc_table() -> np.ndarray:
    """Bytewise steps of CRC-32 (polynomial 0xEDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = crc_table()


def crc_of_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of each span, from the given registers."""
    length = end - start
    state = state.copy()
    for i in np.flatnonzero(length > LONG_WORD):
        state[i] = zlib.crc32(data[start[i] : end[i]], int(state[i] ^ ALL_BITS)) ^ 0xFFFFFFFF
    short = np.flatnonzero(length <= LONG_WORD)
    order = short[np.argsort(-length[short].astype(np.int16), kind="stable")]
    first, register, size = start[order], state[order], length[order]
    for j in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -j, side="left"))  # spans longer than j
        byte = data[first[:m] + j]
        register[:m] = CRC[(register[:m] ^ byte) & 255] ^ (register[:m] >> 8)
    state[order] = register
    return state


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of every run of 1 to ``longest`` words, and the words of each row."""
    data = LOWER[data]
    start, end, row = word_spans(data, offsets, WORD_BYTES)
    state = np.full(len(start), ALL_BITS, np.uint32)
    found, rows = [], []
    for n in range(1, longest + 1):
        m = len(start) - n + 1
        if m <= 0:
            break
        state = state[:m]
        if n > 1:
            state = CRC[(state ^ np.uint32(32)) & 255] ^ (state >> 8)
        state = crc_of_spans(data, start[n - 1 :], end[n - 1 :], state)
        whole = row[:m] == row[n - 1 :]
        found.append(((state ^ ALL_BITS)[whole] % np.uint32(buckets)).astype(np.int64))
        rows.append(row[:m][whole])
    words = np.bincount(row, minlength=len(offsets) - 1)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), words
    return np.concatenate(found), np.concatenate(rows), words


def count_buckets(texts: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = binary_column(batch.column(0))
            for _, part, cut in chunks(np.arange(batch.num_rows), data, offsets):
                total += np.bincount(features(part, cut, longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = texts.select(F.col(text).alias("text")).mapInArrow(task, "bucket long, n long")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln) of the smoothed frequency in the target over that in the source."""
    size, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (all_s + size) / ((s + 1.0) * (all_t + size))))
         for s, t in zip(source.tolist(), target.tolist())], np.int64,
    )


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    buckets = len(gain)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_column(batch.column(1))
            words, counts, weights = [], [], []
            for _, part, cut in chunks(np.arange(batch.num_rows), data, offsets):
                bucket, row, n = features(part, cut, longest, buckets)
                order = np.argsort(row, kind="stable")  # runs of several words come after single words
                sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
                edge = np.searchsorted(row[order], np.arange(len(n) + 1))
                words.append(n)
                counts.append(np.diff(edge))
                weights.append(np.diff(sums[edge]))
            flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (words, counts, weights)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in flat]],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_features long, weight long"
    return docs.select("doc_id", "text").mapInArrow(task, schema)


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 G) of a standard Gumbel variable drawn by the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def bracket(scores: DataFrame, column: str, wanted: int, total: int) -> tuple[int | None, int | None, int]:
    """Bounds around the ``wanted``-th highest value, and how many values lie above them.

    Both bounds belong to the bracket; None is open. The counts are exact, so the bracket
    returned does hold the value.
    """
    width = BRACKET
    while True:
        at = 1 - wanted / total
        ends = [at - width, at + width]
        grid = F.array(*[F.lit(float(min(max(p, 0.0), 1.0))) for p in ends])
        sketch = scores.agg(F.kll_sketch_agg_bigint(column, SKETCH_SIZE).alias("s"))
        low, high = sketch.select(F.kll_sketch_get_quantile_bigint("s", grid)).first()[0]
        low = None if ends[0] <= 0 else low
        high = None if ends[1] >= 1 else high
        over = F.lit(False) if high is None else F.col(column) > F.lit(high)
        under = F.lit(False) if low is None else F.col(column) < F.lit(low)
        found = scores.agg(F.count_if(over).alias("above"), F.count_if(~over & ~under).alias("inside")).first()
        if found["above"] < wanted <= found["above"] + found["inside"]:
            return low, high, found["above"]
        width *= 8


def draw(scored: DataFrame, share: int, least_words: int) -> DataFrame:
    """``rank`` (from 1, by falling score, then id) of the drawn rows, null for the others.

    ``scored`` is a staged table. Drawn are floor(share / 100) of the rows with an id and at
    least ``least_words`` words.
    """
    fit = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    pool = scored.where(fit)
    total = pool.count()
    wanted = share * total // 100
    none = F.lit(None).cast("long")
    if wanted == 0:
        return scored.withColumn("rank", none)
    low, high, above = bracket(pool, "score", wanted, total)
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col("score") >= F.lit(low))
    if high is not None:
        inside = inside & (F.col("score") <= F.lit(high))
    # Ties beyond score and id are rows of one id and one score.
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    sorted_, path = numbered(pool.where(inside).select("score", "doc_id"), [], order, "place")
    cut = sorted_.where(F.col("place") == wanted - above - 1).select("score", "doc_id").first()
    discard(scored.sparkSession, path)
    reached = (F.col("score") > F.lit(cut["score"])) | (
        (F.col("score") == F.lit(cut["score"])) & (F.col("doc_id") <= F.lit(cut["doc_id"]))
    )
    drawn = F.coalesce(fit & reached, F.lit(False))
    ranked, _ = numbered(scored.where(drawn), [], order, "place")
    # Rows that repeat the id at the cutoff may reach one place too far.
    rank = F.when(F.col("place") < wanted, F.col("place") + 1)
    rest = scored.where(~drawn).withColumn("rank", none)
    return ranked.withColumn("rank", rank).drop("place").unionByName(rest)


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    share: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    longest: int = 1,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``.

    Null and empty texts have no features, weight 0 and their noise as score, but too few words
    to be drawn. A row without doc_id has a weight but neither score nor rank. Rows that repeat a
    doc_id share its noise and are drawn one by one; equal rows in any order. An empty table
    gives no rows; an empty target leaves every gain at the smoothed source frequency. Only
    doc_id and text are read, whatever else the tables hold.
    """
    gain = gains(count_buckets(docs, "text", longest, buckets), count_buckets(target, "text", longest, buckets))
    weighed = weigh(docs, gain, longest)
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored, _ = stage(scored, "scored")
    return draw(scored, share, least_words)
