"""Exact order statistics per group that hold when one group is a third of the data.

A window over a month sorts the whole month in one task, and the built-in exact
percentile keeps every distinct value of a group in one buffer. Both are the fastest
way while groups are small and both break on a hot group. ``largest_group`` measures
the groups; beyond ``HOT_ROWS`` the wanted ranks are *selected* instead:

1. One pass builds a mergeable quantile sketch per group and brackets every wanted
   rank between two values. Groups of few rows are bracketed whole.
2. A second pass keeps only the rows inside a bracket and folds everything between
   brackets into one counted row per gap (a map-side combined aggregation).
3. The kept rows are range-partitioned by (group, value, tie-break), so ties and hot
   groups spread over tasks; running counts plus per-partition offsets give exact
   ranks, and the rows that hit a wanted rank are the answer.

The result has one row per group. It is checked (every wanted rank must have hit a
kept row) and, should a bracket ever miss, selected again with open brackets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import attach, attach_side, hold, release, settle_measured, side

# Rows of one group that a single task may sort.
HOT_ROWS = 2_000_000
# Sketch size (rank error about 0.1 %) and half-width of a bracket as a share of rows.
SKETCH_SIZE = 4_000
BRACKET = 0.004
# Groups below this size are taken whole: the bracket would be narrower than two rows.
WHOLE_GROUP = int(2 / BRACKET)


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group; reads the group columns only."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


@dataclass(frozen=True)
class Target:
    """A wanted rank: where it roughly lies (0..1) and its exact formula of the count."""

    position: float
    rank: Callable[[Column], Column]


def _sketch(base: DataFrame, by: list[str], targets: Sequence[Target]) -> DataFrame:
    low = [max(t.position - BRACKET, 0.0) for t in targets]
    high = [min(t.position + BRACKET, 1.0) for t in targets]
    at = F.array(*[F.lit(float(p)) for p in low + high])
    m = len(targets)
    return (
        base.groupBy(*by)
        .agg(F.count("_x").alias("_n"), F.kll_sketch_agg_double("_x", SKETCH_SIZE).alias("_s"))
        .withColumn("_grid", F.kll_sketch_get_quantile_double("_s", at))
        .withColumn("_open", F.col("_n") < WHOLE_GROUP)
        .select(
            *by,
            "_n",
            F.array(*[t.rank(F.col("_n")).cast("long") for t in targets]).alias("_ranks"),
            F.when(~F.col("_open"), F.slice("_grid", 1, m)).alias("_low"),
            F.when(~F.col("_open"), F.slice("_grid", m + 1, m)).alias("_high"),
        )
    )


def _kept(base: DataFrame, by: list[str], ties: list[str], m: int) -> DataFrame:
    """Rows inside a bracket, plus one counted row per gap between brackets."""
    x = F.col("_x")
    inside = F.col("_low").isNull()
    gap = F.lit(None).cast("double")
    for i in range(m):
        lo, hi = F.col("_low")[i], F.col("_high")[i]
        inside = inside | ((x >= lo) & (x <= hi))
        gap = F.when(x > hi, hi).otherwise(gap)
    inside = F.coalesce(inside, F.lit(False))
    placed = base.select(
        *by,
        # A gap row sorts right behind the last bracket below it.
        F.when(inside, x).otherwise(gap).alias("_pos"),
        F.when(inside, F.lit(0)).otherwise(F.lit(1)).alias("_gap"),
        *[F.when(inside, F.col(c)).alias(c) for c in ties],
    )
    return placed.groupBy(*by, "_pos", "_gap", *ties).agg(F.count(F.lit(1)).alias("_w"))


def _hits(
    kept: DataFrame, brackets: DataFrame, by: list[str], ties: list[str]
) -> tuple[DataFrame, bool]:
    """Rows that reach a wanted rank, by exact running counts over range partitions; and
    whether any wanted rank fell outside its bracket."""
    order = ["_pos", "_gap", *ties]
    ranged = hold(
        kept.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    )
    chunk = W.partitionBy(*by, "_part")
    # One row per (group, partition): at most partitions + groups rows in total.
    totals = ranged.groupBy(*by, "_part").agg(F.sum("_w").alias("_chunk"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_part", F.coalesce(F.sum("_chunk").over(before), F.lit(0)).alias("_off")
    )
    running = F.sum("_w").over(chunk.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    ranked = ranged.withColumn("_run", running)
    ranked = attach(ranked, offsets, [*by, "_part"], "inner")
    top = F.col("_off") + F.col("_run")
    ranked = ranked.withColumn("_top", top).withColumn("_bottom", top - F.col("_w"))
    ranked = attach_side(ranked, brackets, by, "inner")
    spot = F.filter(
        F.transform("_ranks", lambda r, i: F.struct(r.alias("r"), i.alias("i"))),
        lambda s: (s["r"] > F.col("_bottom")) & (s["r"] <= F.col("_top")),
    )
    hit = ranked.select(*by, "_n", *order, F.explode(spot).alias("_s"))
    found = hit.groupBy(*by).agg(
        F.max("_n").alias("n"),
        F.max("_gap").alias("_missed"),
        # At most one entry per wanted rank.
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("_s.i").alias("i"), F.struct(F.col("_pos").alias("x"), *ties).alias("t")
                )
            )
        ).alias("_found"),
    )
    out, seen = settle_measured(
        found.select(*by, "n", "_missed", F.transform("_found", lambda s: s["t"]).alias("cuts")),
        F.max("_missed").alias("missed"),
    )
    release(ranged)
    return out, bool(seen["missed"])


def select_ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str | Column,
    targets: Sequence[Target],
    ties: Sequence[str] = (),
) -> DataFrame:
    """One row per group: ``n`` (non-null values) and ``cuts``, the row at each rank.

    ``cuts[i]`` is ``struct(x, *ties)`` of the row whose rank, in the order of the value
    and then the tie-break columns, equals ``targets[i].rank(n)``.
    """
    by, ties = list(by), list(ties)
    x = F.col(value) if isinstance(value, str) else value
    base = df.select(
        *by, *ties, F.nanvl(x.cast("double"), F.lit(None).cast("double")).alias("_v")
    )
    # Adding zero turns -0.0 into 0.0, so that equal values compare as equal.
    base = base.withColumn("_x", F.col("_v") + F.lit(0.0)).drop("_v").where("_x is not null")
    keyed = by
    if not by:
        base, keyed = base.withColumn("_whole", F.lit(1)), ["_whole"]
    brackets = side(_sketch(base, keyed, targets))
    m = len(targets)
    marked = attach_side(base, brackets, keyed, "inner")
    out, missed = _hits(_kept(marked, keyed, ties, m), brackets, keyed, ties)
    if missed:
        nothing = F.lit(None).cast(T.ArrayType(T.DoubleType()))
        marked = base.select("*", nothing.alias("_low"), nothing.alias("_high"))
        out, _ = _hits(_kept(marked, keyed, ties, m), brackets, keyed, ties)
    return out.select(*by, "n", "cuts")


def _quantile_targets(probs: Sequence[float]) -> list[Target]:
    out = []
    for p in probs:
        out.append(Target(p, lambda n, p=p: F.floor((n - 1) * F.lit(p)) + 1))
        out.append(Target(p, lambda n, p=p: F.ceil((n - 1) * F.lit(p)) + 1))
    return out


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per group, ``q_<column>`` arrays.

    Missing values (NULL or NaN) are left out; a column without values has NULL.
    """
    by, columns = list(by), list(columns)
    if largest_group(df, by) <= hot_rows:
        at = F.array(*[F.lit(float(p)) for p in probs])
        clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
        return df.groupBy(*by).agg(*[F.percentile(clean[c], at).alias(f"q_{c}") for c in columns])
    long = melt(df, by, columns)
    cuts = select_ranks(long, [*by, "_variable"], "_value", _quantile_targets(probs))
    values = []
    for i, p in enumerate(probs):
        a, b = F.col("cuts")[2 * i]["x"], F.col("cuts")[2 * i + 1]["x"]
        spot = (F.col("n") - 1) * F.lit(float(p))
        part = spot - F.floor(spot)
        # Between equal values nothing is interpolated: infinities would give NaN.
        values.append(F.when((a == b) | (part == 0), a).otherwise(a + (b - a) * part))
    long_q = cuts.select(*by, "_variable", F.array(*values).alias("_q"))
    return long_q.groupBy(*by).agg(
        *[F.max(F.when(F.col("_variable") == c, F.col("_q"))).alias(f"q_{c}") for c in columns]
    )


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long (ids, _variable, _value) rows; works without id columns as well."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("_variable"), F.col(c).cast("double").alias("_value"))
                for c in columns
            ]
        )
    )
    return df.select(*ids, pairs.alias("_p")).select(*ids, "_p._variable", "_p._value")
