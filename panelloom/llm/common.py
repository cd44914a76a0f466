"""What the text operators share: staged tables, packed rows, text chunks, components.

Rows per n-gram would cost far more than the n-grams themselves, so operators that count
n-grams move *packed* rows: arrays of many entries in binary columns, one row per task and
fragment of the key space. The number of fragments follows the number of input partitions,
so a fragment stays about as large as a partition at every size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelloom.session import side, staging_path

# Functions sent to tasks travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

CHUNK_BYTES = 1 << 20
# Odd multipliers of the hash functions (fixed values).
MULTIPLIER = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Lets Spark delete the shuffle files of a query as soon as the query has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a frame to the shared folder and read it back: cut lineage, fixed rows.

    What was shuffled for it is of no use once the table is there, and goes.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def partitions(df: DataFrame) -> int:
    """Input partitions of a scan; they follow the bytes of the input."""
    return max(1, df.rdd.getNumPartitions())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_A)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = MULTIPLIER) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse modulo 2^64 for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        column = np.full(max(n, 1), b, dtype=np.uint64)
        column[0] = 1
        out.append(np.cumprod(column, dtype=np.uint64))
    return out[0], out[1]


class SpanHasher:
    """Hashes of byte spans from prefix sums; equal bytes give equal hashes anywhere."""

    def __init__(self) -> None:
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))
        self.up, self.down = powers(1 << 16)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        return self.prefix_of(self.table[data])

    def prefix_of(self, values: np.ndarray) -> np.ndarray:
        """The same for a sequence of 64-bit hashes."""
        n = len(values)
        if n >= len(self.up):
            self.up, self.down = powers(2 * n)
        out = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary or string column, without a copy per row.

    A null has length 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # still chunked: no rows
        column = pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray,
           size: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cut a column into runs of whole rows of about ``size`` bytes."""
    first = 0
    while first < len(ids):
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right"))
        last = min(max(last - 1, first + 1), len(ids))
        start, end = offsets[first], offsets[last]
        yield ids[first:last], data[start:end], offsets[first : last + 1] - start
        first = last


def by_key(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by a small key, the distinct keys and where each starts (and the end)."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(key) else np.empty(0, int)
    return order, ordered[starts], np.r_[starts, len(key)]


def joined(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """All entries of a packed column."""
    data, _ = binary_column(column)
    return np.frombuffer(data.tobytes(), dtype=kind)


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values starts in sorted columns."""
    n = len(columns[0])
    if n == 0:
        return np.empty(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node.

    Alternates the large-star and small-star steps until the edges form stars. Each step
    is two shuffles of the edges; a hub is one key whose small side is unique, so Spark's
    skew join splits it. Nodes without an edge do not appear.
    """
    spark = edges.sparkSession
    current = edges.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).where("u <> v").distinct()
    current, path = stage(current, "edges")
    while True:
        tops = current.select(F.col("v").alias("u")).distinct()
        left = current.groupBy("u").agg(F.count(F.lit(1)).alias("n")).join(
            tops.withColumn("top", F.lit(1)), "u", "left"
        ).where("n > 1 OR top = 1").limit(1).count()
        if left == 0:
            break
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        following, following_path = stage(small, "edges")
        discard(spark, path)
        current, path = following, following_path
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


# Lower-cases A-Z and leaves every other byte of UTF-8 as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes with ``inside[byte]``; none crosses rows.

    ``offsets`` cuts ``data`` into rows, as of an Arrow column.
    """
    n = len(data)
    if n == 0:
        nothing = np.empty(0, np.int64)
        return nothing, nothing, nothing
    held = inside[data]
    fresh = held.copy()
    fresh[1:] &= ~held[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    fresh[cut] = held[cut]
    last = held.copy()
    last[:-1] &= ~held[1:]
    last[cut - 1] = held[cut - 1]
    start, end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def numbered(df: DataFrame, by: list[str], order: list[Column], number: str) -> tuple[DataFrame, str]:
    """Every row with its place, from 0 without gaps, in its group; and the staged path.

    Rows are dealt by ranges of (group, order), so neither a group nor a run of ties has to
    fit a task; rows equal in all that are told apart by their place in the input, which must
    therefore be a staged table or a scan. One range is numbered as it is written; the ranges
    of a group are then added up from one row per (range, group).
    """
    spark = df.sparkSession
    keys = [*[F.col(c) for c in by], *order, F.col("_row")]
    dealt = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys)
    placed = dealt.sortWithinPartitions(*keys).drop("_row").withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    placed, path = stage(placed, number)
    sums = placed.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by, F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = placed.join(side(sums), [*by, "_range"])
    place = F.col("_at") - F.col("_first") + F.col("_before")
    return joined.withColumn(number, place).drop("_at", "_range", "_first", "_before"), path
