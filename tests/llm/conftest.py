import pytest
from pyspark.sql import types as T

from panelloom.session import build_session

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Columns that clash with names used inside the operators.
    T.StructField("label", T.IntegerType()), T.StructField("frag", T.StringType()),
    T.StructField("block", T.StringType()), T.StructField("token", T.StringType()),
])


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table of (doc_id, text[, lang]) with extra, clashing columns."""

    def make(*rows):
        full = [(*r, *([None] * (3 - len(r))), "s", 0, 1, "f", "b", "t") for r in rows]
        return spark.createDataFrame(full, DOCUMENT)

    return make


WORDS = (
    "stone river cloud paper window garden silver engine market bridge copper forest signal planet"
    " ladder winter summer castle pocket mirror"
).split()


def prose(seed: int, n: int) -> str:
    """n words in a fixed pseudo-random order."""
    out, x = [], seed * 2654435761 % (1 << 32)
    for _ in range(n):
        x = (1103515245 * x + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 7))
    return " ".join(out)


AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (6, "é" * 300), (7, "a" * 5000),
    (8, prose(1, 400)), (9, prose(1, 400)), (10, prose(1, 380) + " " + prose(2, 20)), (11, prose(3, 5000)),
]
