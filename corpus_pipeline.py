"""Documents to packed training sequences: quality rules, line dedup, SimHash near-dedup, mixing, packing.

Each stage works on all that its predecessor kept, written as Parquet in the shared folder and read
again. All but the last return the columns of documents, whatever further columns these have and
whatever their names. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridtally.llm import lines, mixing, packing, quality, simhash
from gridtally.llm.common import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    A null or empty text has no words and goes; a null doc_id makes no difference; repeated rows are
    judged alike. Without labels of both classes only the base rules decide.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.filtered(docs, quality.train(docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of five or more documents stay in the one with the largest doc_id.

    Rows without doc_id are one document, with the smallest of all ids; so are rows that share an id.
    A text that loses all its lines is empty, a null text stays null. n_chars follows the text.
    """
    return lines.deduplicated(docs, min_chars=40, min_docs=5)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id, null before all.

    Of several rows with that id and the same text one stays. Texts without words have one fingerprint,
    so one of them stays. Groups that share their smallest id, or lack one, keep a row each.
    """
    return simhash.one_of_each(docs, shingle=4, distance=4)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times.

    Null is a source of its own. Equal rows are taken together. A text without words is in the mix as
    often as any other of its source with the same hash.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens.

    A null or empty text is its end id alone; repeated rows are packed once each; a null doc_id stays
    null. No token is dropped.
    """
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A trained model and a tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = stored(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return rows
