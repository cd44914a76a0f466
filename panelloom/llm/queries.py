"""Registered queries of the text operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, collocations, cover_tree, decontaminate, html_text, jaccard, langid, resample, sharding, suffix, toxicity,
    url_tree, windows,
)
from .common import read
from .sql import COLLOCATIONS_SQL, RESAMPLE_SQL, SHARDS_SQL

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "word_bpe_49k.json"
URL_RULES = (
    url_tree.Rule.of("org/", block=False),
    url_tree.Rule.of("example.org/es/", block=True),
    url_tree.Rule.of("example.org/en/1", block=True),
    url_tree.Rule.of("com/fr/", block=False),
    url_tree.Rule.of("com/de/", block=True),
)


def vocabulary() -> str:
    return str(public_tokenizers.path(VOCABULARY))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(read(spark, sf_dir, "documents"), vocabulary(), keep=False)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_tree.judge_urls(read(spark, sf_dir, "pages"), list(URL_RULES))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_groups(read(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read(spark, sf_dir, "documents"), with_text=False)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.repeated_passages(read(spark, sf_dir, "documents"))


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(read(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit_languages(docs.where(~held))
    found = langid.predict_languages(docs, model)
    return found.withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score", "langs", "shares")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit_toxicity(docs.where(~held), labels.where(~held))
    found = toxicity.score_toxicity(docs, model)
    return found.withColumn("held_out", held).select("doc_id", "held_out", "score", "predicted")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_bpe, op2_url_filter, op3_ngram_join, op4_html_text, op5_suffix_dedup, op6_decontaminate,
        op7_compact_windows, op8_cover_tree, op9_language_id, op10_toxicity, op11_importance_resample,
        op12_rendezvous_shards, op13_collocations,
    )
}
SQL: dict[str, str] = {
    "op11_importance_resample": RESAMPLE_SQL,
    "op12_rendezvous_shards": SHARDS_SQL,
    "op13_collocations": COLLOCATIONS_SQL,
}
