"""Pruned scans, committed results and user functions."""

import datetime as dt
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.catalog.studies import ridge_config
from panelloom.operators import hooks
from panelloom.panel import Panel
from panelloom.plans.study import run_study
from panelloom.sources import commits
from panelloom.sources.readers import read_panel

cloudpickle.register_pickle_by_value(sys.modules[__name__])
PANEL = Panel("month", ("sec",), ("x",), types={"sec": T.StringType()})


@pytest.fixture
def rows(spark):
    days = [dt.date(2000 + i // 12, i % 12 + 1, 1 + i % 20) for i in range(48)]
    return spark.createDataFrame([(d, f"S{i}", float(i)) for i, d in enumerate(days)], "month date, sec string, x double")


def test_month_limits_reach_the_files(spark, rows, tmp_path, capsys):
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        rows.write.format(fmt).option("header", True).save(path)
        got = read_panel(spark, path, PANEL, fmt, begin="2001-02-17", end="2001-04-03")
        assert sorted((r.month, r.sec) for r in got.collect()) == [
            (dt.date(2001, 2, 1), "S13"), (dt.date(2001, 3, 1), "S14"), (dt.date(2001, 4, 1), "S15")]
        got.explain("formatted")
        plan = capsys.readouterr().out
        pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
        assert pushed and "GreaterThanOrEqual(month,2001-02-01)" in pushed[0] and "LessThan(month,2001-05-01)" in pushed[0]


def test_broken_and_foreign_results_are_not_read(spark, rows, tmp_path):
    path, calls = str(tmp_path / "cached"), []

    def compute(scale=1):
        calls.append(scale)
        return rows.select(F.col("x") * scale)

    rows.limit(3).write.parquet(f"{path}/data-half")  # a run that broke before its manifest
    first = commits.read_or_compute(spark, path, compute, mark="a")
    assert first.count() == 48 and calls == [1]
    assert commits.read_or_compute(spark, path, compute, mark="a").count() == 48 and calls == [1]
    other = commits.read_or_compute(spark, path, lambda: compute(2), mark="b")
    assert calls == [1, 2] and other.agg(F.max("*")).first()[0] == 94.0
    commits.read_or_compute(spark, path, compute, read_last=False, mark="b")
    assert calls == [1, 2, 1]


def test_fingerprints_follow_configuration_and_files(spark, rows, tmp_path):
    path = str(tmp_path / "panel")
    rows.write.parquet(path)
    one = commits.fingerprint({"k": 3}, spark.read.parquet(path))
    assert one == commits.fingerprint({"k": 3}, spark.read.parquet(path))
    assert one != commits.fingerprint({"k": 4}, spark.read.parquet(path))
    rows.limit(5).write.mode("append").parquet(path)
    assert one != commits.fingerprint({"k": 3}, spark.read.parquet(path))


def test_a_study_reads_a_whole_search_only(spark, tmp_path, monkeypatch):
    from panelloom.plans import study

    data = [(dt.date(2000 + m // 12, m % 12 + 1, 1), s, float((7 * m + 3 * s) % 11), float((5 * m + s) % 7))
            for m in range(36) for s in range(12)]
    panel = spark.createDataFrame(data, "month date, sec long, x1 double, x2 double")
    panel = panel.withColumn("fq_ret", F.col("x1") / 10 - F.col("x2") / 20).withColumn("fm_ret", F.col("fq_ret") / 3)
    panel.write.parquet(str(tmp_path / "panel"))
    panel = spark.read.parquet(str(tmp_path / "panel"))
    config = ridge_config(test_begin="2002-01-01", test_end="2002-12-31", param_grid={"alpha": [1.0, 50.0]}, k=2)
    searched = []
    search = study.search
    monkeypatch.setattr(study, "search", lambda *a: searched.append(1) or search(*a))
    root = str(tmp_path / "out")

    def run(c, **more):
        return sorted(map(str, run_study(spark, c, panel, root, "m", **more)["cv_results"].collect()))

    first = run(config)
    assert run(config, read_last=True) == first and len(searched) == 1
    commits.withdraw(spark, root, "m")  # as if the run had broken
    run(config, read_last=True)
    assert len(searched) == 2


# ---- user functions ------------------------------------------------------------------------------


@pytest.fixture
def grouped(spark):
    data = [(i % 3 if i % 10 else None, i, float(i * i % 17)) for i in range(90)]
    return spark.createDataFrame(data, "g int, id int, v double")


def total(rows):
    return pd.DataFrame({"g": rows["g"].iloc[:1], "s": [rows["v"].sum()], "n": [len(rows)]})


def test_group_functions(grouped):
    want = {r.g: (r.s, r.n) for r in grouped.groupBy("g").agg(F.sum("v").alias("s"), F.count("*").alias("n")).collect()}
    merge = lambda parts: pd.DataFrame({"g": parts["g"].iloc[:1], "s": [parts["s"].sum()], "n": [parts["n"].sum()]})
    for more in ({}, {"merge": merge, "limit": 4}):
        got = hooks.apply_groups(grouped, ["g"], total, "g int, s double, n long", **more)
        assert {r.g: (r.s, r.n) for r in got.collect()} == want
    sizes = []
    parts = hooks.parts_of(grouped, ["g"], 10).groupBy("g", "_part").count().collect()
    sizes = [r["count"] for r in parts]
    assert sum(sizes) == 90 and max(sizes) <= 10


def test_rows_of_later_partitions_are_dealt(spark):
    # The row ids of the last of many partitions are far beyond 32 bits.
    rows = spark.range(0, 4000, 1, 40).selectExpr("CAST(id % 2 AS INT) AS g", "CAST(id AS DOUBLE) AS v")
    sizes = [r["count"] for r in hooks.parts_of(rows, ["g"], 200).groupBy("g", "_part").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 200 and len(sizes) == 40


def test_large_groups_are_named(grouped):
    with pytest.raises(ValueError, match="has 27 rows, at most 5"):
        hooks.apply_groups(grouped, ["g"], total, "g int, s double, n long", limit=5)


def test_transforms_elements_rows_and_pairs(grouped):
    ranked = hooks.transform_groups(grouped, ["g"], "v", lambda v: v - v.mean(), "gap", order=["id"])
    assert ranked.columns == ["g", "id", "v", "gap"] and ranked.count() == 90
    assert all(abs(r.s) < 1e-9 for r in ranked.groupBy("g").agg(F.sum("gap").alias("s")).collect())
    doubled = hooks.apply_elements(grouped, ["v", "id"], lambda v, i: v * 2 + i, "w", "double")
    assert doubled.where("w <> v * 2 + id").count() == 0
    kept = hooks.apply_rows(grouped, lambda f: f[f["v"] > 3][["id"]], "id int")
    assert kept.count() == grouped.where("v > 3").count()

    def sizes(a, b):
        return pd.DataFrame({"a": [len(a)], "b": [len(b)]})

    got = hooks.apply_cogroups(grouped.where("g = 0"), grouped.where("g < 2"), ["g"], sizes, "a long, b long")
    assert sorted((r.a, r.b) for r in got.collect()) == [(0, 27), (27, 27)]


def test_nothing_through_the_hooks(grouped):
    none = grouped.where("id < 0")
    assert hooks.apply_groups(none, ["g"], total, "g int, s double, n long").count() == 0
    assert hooks.transform_groups(none, ["g"], "v", lambda v: v, "w").count() == 0
