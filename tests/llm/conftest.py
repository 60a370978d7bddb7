from __future__ import annotations

import pytest
from pyspark.sql import types as T

LONG = "word " * 60_000 + "end"
PASSAGE = "This passage of more than fifty bytes is shared by several of the documents here."

#: Extra columns carry names that the operators use inside.
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("row", "size", "hash", "fp", "key", "keep", "bitmap", "own_row", "mix_hash", "kept_doc", "anchor", "y", "part", "component")]
)


def documents(rows):
    """(doc_id, text, source) rows with all columns of DOCS."""
    return [(i, t, "en", s, len(t or ""), *["x"] * 14) for i, t, s in rows]


MESSY = [
    (1, None, "b"), (2, "", "a"), (3, " \t\n\x0b\x0c\r ", "a"), (4, LONG, "a"), (5, PASSAGE, "b"), (6, f"Before it. {PASSAGE} After it.", None),
    (7, PASSAGE.upper(), "c"), (8, PASSAGE, "é"), (8, PASSAGE, "é"), (8, "another text of the same id, long enough to be a line of its own", "c"),
    (None, PASSAGE, "b"), (10, f"  {PASSAGE}\nnew line\n{PASSAGE}  ", "a"), (11, f"{PASSAGE}\n", None), (12, "ünïcödé wörds 漢字 \U0001f600 and\x00zero bytes", "a"), (13, LONG, "b"),
]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(documents(MESSY), DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 14)] + [(99, 1, 1), (None, 1, 0), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
