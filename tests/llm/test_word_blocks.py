"""Words are split in bounded blocks of text."""

import pyarrow as pa

from panelloom.llm import collocations


def test_words_are_split_a_block_at_a_time():
    texts = ["some words of a text " * 500] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 300), pa.array(texts)], names=["lang", "text"])
    parts = [(len(w.data), len(w.unit)) for w, _ in collocations.word_batches(iter([batch]))]
    assert max(size for size, _ in parts) <= collocations.BLOCK == 1 << 20
    assert sum(n for _, n in parts) == 300 * 2500
