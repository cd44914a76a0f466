"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number from the hash of (shard, key) and its weight; the highest number
has the record. Nothing but the key and the list of weights decides, so a record keeps its
shard across runs, files and clusters, and a further shard only takes the records whose
highest number it draws. All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, stage

SHARDS = 16
BITS = 52  # of a hash, 13 hexadecimal digits: exact in a double


def record_key(doc_id: Column, text: Column) -> Column:
    """The id; rows without one are told apart by their text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))


def draws(key: Column, weights: Sequence[float]) -> Column:
    """One number per shard: -weight / ln(u), u in (0, 1) from the hash of "shard:key"."""
    pairs = F.array(*[F.struct(F.lit(str(i)).alias("name"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])

    def one(pair: Column) -> Column:
        digits = F.substring(F.md5(F.concat(pair["name"], F.lit(":"), key)), 1, BITS // 4)
        u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**BITS)
        return -pair["weight"] / F.log(u)

    return F.transform(pairs, one)


def highest(numbers: Column) -> Column:
    """Place of the highest number; the first one on ties."""
    return F.array_position(numbers, F.array_max(numbers)).cast("int") - 1


def assign_shards(df: DataFrame, key: Column, weights: Sequence[float], output: str = "shard") -> DataFrame:
    """``df`` with the shard of every row, 0 to len(weights) - 1; weights are positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return df.withColumn(output, highest(draws(key, weights)))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float]) -> DataFrame:
    """Write whole rows to ``path/shard=N`` and return (shard, rows, bytes), one row per shard.

    Rows travel as one struct column, so their own names never clash with the layout. A
    rebalanced shuffle cuts heavy shards over several tasks and files.
    """
    spark = docs.sparkSession
    packed = docs.select(F.struct(*docs.columns).alias("record"))
    key = record_key(F.col("record.doc_id"), F.col("record.text"))
    dealt = assign_shards(packed, key, weights).hint("rebalance", "shard")
    dealt.write.partitionBy("shard").parquet(path)
    size = F.coalesce(F.octet_length("record.text"), F.lit(0)).cast("long")
    written = spark.read.schema(dealt.schema).parquet(path)
    return written.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"))


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, more: float = 1.0) -> DataFrame:
    """One row per document: size, text_crc32, shard, slot and the shard after growth.

    ``slot`` numbers the rows of a shard from 0 by doc_id, size and checksum; ``grown_shard`` is
    the shard once a shard of weight ``more`` has been added. A null text counts as empty
    (size 1, checksum 0). Rows that repeat a doc_id share its shard, rows without doc_id go by
    their text; equal rows have neighbouring slots. An empty table gives no rows. Only doc_id and text
    are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    numbers = F.col("_numbers")
    n = len(weights)
    own = F.slice(numbers, 1, n)
    thin = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        draws(record_key(F.col("doc_id"), F.col("text")), [*weights, more]).alias("_numbers"),
    )
    grown = F.when(numbers[n] > F.array_max(own), F.lit(n)).otherwise(highest(own))
    thin = thin.withColumn("shard", highest(own)).withColumn("grown_shard", grown).drop("_numbers")
    staged, _ = stage(thin, "shards")
    order = [F.col(c).asc() for c in ("doc_id", "size", "text_crc32")]
    out, _ = numbered(staged, ["shard"], order, "slot")
    return out.withColumn("law", F.lit("key"))
