"""Preparation of a training corpus: five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns documents again; the last returns tokens.
A stage works on all that the one before kept. Rows without a doc_id leave in the second
stage, as groups are named by ids; empty tables pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import bpe, decontaminate, jaccard, langid, suffix
from panelloom.llm.common import read, stage
from panelloom.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SHARE = 0.4  # of the main language; below it a text has none


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a main language go; ``lang`` stays as given.

    The prediction joins back by doc_id, so a doc_id that occurs twice stays if one of its
    texts has a language.
    """
    model = langid.fit_languages(docs)
    found = langid.predict_languages(docs, model)
    known = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return docs.join(known.select("doc_id").distinct(), "doc_id", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates stays."""
    groups = jaccard.ngram_groups(docs)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*COLUMNS)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that an earlier document holds are cut out."""
    kept = suffix.remove_repeats(docs).select("doc_id", F.col("kept_text").alias("text"))
    rest = docs.select("doc_id", "lang", "source")
    return kept.join(rest, "doc_id").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    hits = decontaminate.find_passages(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and decoded text."""
    return bpe.bpe_encode(docs, vocabulary()).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("suffix_dedup", repeated_text),
    ("decontamination", decontamination),
    ("bpe", tokens),
]
# No stage can be expressed in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs, _ = stage(step(spark, docs, sf_dir), name)
    return docs
