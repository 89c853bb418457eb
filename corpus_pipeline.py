"""Corpus pipeline: from raw documents to packed training windows.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame: all but the last the columns of ``documents``, the last one
the packed pieces. A stage's output is written and read again as the next one's
input. An empty input passes through every stage as an empty table.

SQL cannot express the models and the tokenizer, so there is no oracle; the
tests hold the pipeline against a plain version of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablekit.llm import exact_dedup, langid, packing, pii, simhash
from tablekit.llm.common import documents, saved
from tablekit.llm.queries import byte_bpe_files


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose text has an identified language (op 7)."""
    return langid.keep_identified(docs, langid.fit(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the largest doc_id (op 3)."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each SimHash component the row with the smallest doc_id (op 4)."""
    return simhash.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text by its kind in brackets (op 9)."""
    return pii.masked(docs, pii.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens (op 8)."""
    return packing.pack(docs, **byte_bpe_files())


STAGES = [("language_id", language_id), ("exact_dedup", exact_duplicates),
          ("simhash_near_dedup", near_duplicates), ("pii", personal_data), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
