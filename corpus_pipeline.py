"""The corpus pipeline: documents through language ID, exact and near deduplication, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run`` writes what a stage
returns as Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinespark.llm.exact_dedup import drop_copies
from kinespark.llm.language_id import known_language
from kinespark.llm.mixing import mixed_documents
from kinespark.llm.ngram_join import keep_one_per_class
from kinespark.llm.packing import pack
from kinespark.session import ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go.

    Rows are judged alone: ties of languages keep the row, repeated rows stay or go together, long texts are read whole,
    further columns of any name stay, an empty table stays empty.
    """
    return known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts: the one with the most code points, then the smallest doc_id, null last.

    Null and empty texts are equal; of identical repeated rows one stays. Long texts are hashed whole, further columns of any
    name stay, an empty table stays empty.
    """
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class, the one with the smallest doc_id.

    Null texts and texts without words are near to nothing and stay; repeated rows count as one document each. Long texts
    are shingled whole, further columns of any name stay, an empty table stays empty.
    """
    return keep_one_per_class(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them: some not at all, others up to three times.

    A null source is one of its own. Texts without words have size 0 and are taken at the rate of their source; documents that
    share doc_id, source and size are told apart by a number. Long texts count whole, further columns of any name stay, an
    empty table stays empty.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins without two pieces of one source or one text.

    Null and empty texts have no piece. Texts longer than a bin are cut into pieces; repeated rows are numbered as copies, ties
    go to the order of bins. An empty table gives an empty one.
    """
    return pack(docs)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture),
          ("packing", packing)]
#: language ID and packing are beyond SQL; tests hold the pipeline against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents that the stages keep: doc_id, copy, piece, start_word, n_words, bin_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
