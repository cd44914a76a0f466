"""Language identification by a mixture of languages per document.

Training counts character trigrams per language over all training documents. A document is
a set of words, each with a log-likelihood under every language; expectation-maximisation
estimates the proportions of the languages. The set of languages is then chosen by
penalised likelihood: languages leave one by one, weakest first, as long as the loss of
likelihood is smaller than the penalty of a parameter. The language with the largest
proportion is the prediction, its proportion the score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_column, chunks, mix

BITS = 17  # trigrams are hashed into 2^BITS cells
SMOOTHING = 0.1
ROUNDS = 40
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


class Trigrams:
    """Words of letters as rows of hashed trigrams, for many documents at once.

    Works on code points: letters are lower-cased, everything else separates words, and
    a word is read with a space before and after it.
    """

    def __init__(self) -> None:
        points = np.arange(0x110000, dtype=np.uint32)
        fold = np.zeros(0x110000, np.uint32)
        for start in (0, 0xE000):
            stop = 0xD800 if start == 0 else 0x110000
            text = points[start:stop].astype("<u4").tobytes().decode("utf-32-le")
            fold[start:stop] = [ord(c.lower()[0]) if c.isalpha() else 0 for c in text]
        self.fold = fold

    def cells(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashed trigrams, the word of each, and the document of each word."""
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        joined = "\n".join(texts) + "\n"
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        code = self.fold[raw]
        letter = code > 0
        x = np.r_[np.uint32(0), code].astype(np.uint64)
        # The trigram that ends at each position; the separator is 0.
        previous, before = x[:-1], np.r_[np.uint64(0), x[:-2]]
        last = x[1:]
        keep = letter | (previous > 0)
        before = np.where(previous > 0, before, 0)
        gram = (before << np.uint64(42)) ^ (previous << np.uint64(21)) ^ last
        grams = (mix(gram[keep]) >> np.uint64(64 - BITS)).astype(np.int64)
        starts = letter & (previous == 0)
        word = np.cumsum(starts)[keep] - 1
        document = np.searchsorted(np.cumsum(sizes), np.flatnonzero(starts), side="right")
        return grams, word, document


def text_batches(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about one megabyte of text: (first row, texts)."""
    data, offsets = binary_column(batch.column("text"))
    first = 0
    for ids, part, cut in chunks(np.arange(batch.num_rows), data, offsets):
        raw = part.tobytes()
        yield first, [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]
        first += len(ids)


def count_task(langs: list[str]) -> Callable:
    place = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams = Trigrams()
        total = np.zeros((len(langs), 1 << BITS), dtype=np.int64)
        for batch in batches:
            kinds = np.array([place[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for first, texts in text_batches(batch):
                grams, word, document = trigrams.cells(texts)
                lang = kinds[first : first + len(texts)][document[word]]
                total += np.bincount((lang << BITS) + grams, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["cell", "n"])

    return run


class LanguageModel:
    """Log-probability of each trigram cell under each language: a table of fixed size."""

    def __init__(self, langs: list[str], scores: np.ndarray) -> None:
        self.langs = langs
        self.scores = scores  # (cells, languages)


def fit_languages(docs: DataFrame) -> LanguageModel:
    """Count trigrams of ``text`` per ``lang`` over all rows given.

    Rows whose lang or text is null are left out. The result has 2^BITS cells per language,
    whatever the input; the counts are summed in Spark.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("lang").cast("string"), F.col("text").cast("string")
    )
    langs = sorted(r[0] for r in known.select("lang").distinct().collect())
    if not langs:
        return LanguageModel([], np.zeros((1 << BITS, 0)))
    cells = (
        known.mapInArrow(count_task(langs), "cell long, n long")
        .groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    )
    counts = np.zeros(len(langs) << BITS)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.float64)
    counts = counts.reshape(len(langs), 1 << BITS) + SMOOTHING
    return LanguageModel(langs, np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32))


def mixture(loglik: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the languages and the log-likelihood, by expectation-maximisation."""
    top = loglik.max(axis=1, keepdims=True)
    weight = np.exp(loglik - top)
    share = np.full(loglik.shape[1], 1 / loglik.shape[1])
    for _ in range(rounds):
        mass = weight @ share
        following = share * (weight.T @ (1 / mass)) / len(weight)
        done = np.abs(following - share).max() < 1e-3
        share = following
        if done:
            break
    return share, float(np.log(weight @ share).sum() + top.sum())


def language_set(loglik: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Proportions after leaving out languages that penalised likelihood does not pay for."""
    n, k = loglik.shape
    penalty = 0.5 * np.log(n + 1)
    chosen = list(range(k))
    share, best = mixture(loglik)
    while len(chosen) > 1:
        weakest = int(np.argmin(share))
        rest = [c for i, c in enumerate(chosen) if i != weakest]
        less, value = mixture(loglik[:, rest])
        if value < best - penalty:
            break
        chosen, share, best = rest, less, value
    out = np.zeros(k)
    out[chosen] = share
    return out, chosen


PREDICTION = "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>"


def predict_task(model_of: Callable[[], LanguageModel]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, trigrams = model_of(), Trigrams()
        langs = model.langs
        for batch in batches:
            pred, score, names, parts = [], [], [], []
            for _, texts in text_batches(batch):
                grams, word, document = trigrams.cells(texts)
                if len(grams) and langs:
                    begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                    words = np.add.reduceat(model.scores[grams], begin, axis=0)
                else:
                    words = np.zeros((0, len(langs)))
                edges = np.searchsorted(document, np.arange(len(texts) + 1))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if a == b or not langs:
                        pred.append(UNDETERMINED)
                        score.append(0.0)
                        names.append([])
                        parts.append([])
                        continue
                    share, chosen = language_set(words[a:b].astype(np.float64))
                    first = int(np.argmax(share))
                    pred.append(langs[first])
                    score.append(float(min(share[first], 1.0)))
                    names.append([langs[c] for c in chosen])
                    parts.append([float(share[c]) for c in chosen])
            yield pa.RecordBatch.from_pandas(pd.DataFrame({
                "doc_id": batch.column("doc_id").to_pandas(), "lang_pred": pred, "score": score,
                "langs": names, "shares": parts,
            }), schema=pa.schema([
                ("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                ("langs", pa.list_(pa.string())), ("shares", pa.list_(pa.float64())),
            ]), preserve_index=False)

    return run


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Language proportions of every row's ``text``; only the text is read.

    Returns doc_id, lang_pred, score, langs (the chosen set) and shares. ``und`` with score 0
    where the text is null or has no letter, or nothing was learned. Rows are independent:
    repeats stay, other columns are ignored, an empty table gives an empty result. The model
    that travels to the tasks has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.scores))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict_task(lambda: LanguageModel(*shared.value)), PREDICTION)
