"""The pipeline's stages against brute force, and the registry."""

import os
import sys

import corpus_pipeline
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest import AWKWARD, prose  # noqa: E402

import __spark_entry__  # noqa: E402


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, documents, sf_dir):
    given = documents(*[(i, t, "en") for i, t in AWKWARD])
    columns = corpus_pipeline.COLUMNS
    kept = corpus_pipeline.language(spark, given, sf_dir)
    assert kept.columns == columns and ids(kept) == [4, 5, 6, 7, 8, 9, 10, 11]
    first = corpus_pipeline.near_duplicates(spark, kept, sf_dir)
    assert first.columns == columns and ids(first) == [4, 6, 7, 8, 11]
    table = documents((1, prose(1, 40), "en"), (2, prose(2, 9) + " " + prose(1, 40), "en"))
    cut = {r["doc_id"]: r for r in corpus_pipeline.repeated_text(spark, table, sf_dir).collect()}
    assert cut[1]["text"] == prose(1, 40) and cut[2]["text"].strip() == prose(2, 9)
    assert cut[2]["n_chars"] == len(cut[2]["text"]) and cut[2]["lang"] == "en"
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    clean = corpus_pipeline.decontamination(spark, documents((1, prose(5, 50)), (2, prose(6, 9) + item), (3, None)), sf_dir)
    assert clean.columns == columns and ids(clean) == [1, 3]
    assert corpus_pipeline.tokens(spark, clean, sf_dir).where("size(ids) = n_tokens").count() == 2


def test_empty_table_passes_through(spark, documents, sf_dir):
    docs = documents()
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf_dir)
        assert docs.count() == 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 0 < out.count() <= given.count()
    assert out.count() == out.select("doc_id").distinct().count()
    assert out.join(given, "doc_id", "left_anti").count() == 0
    assert out.where(F.col("n_tokens").isNull()).count() == 0


def test_registry():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
