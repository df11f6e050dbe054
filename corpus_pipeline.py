"""Corpus pipeline: language ID, line dedup, near-dedup, redaction of secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Columns beyond ``doc_id``, ``text``, ``lang`` and ``n_chars`` are carried along, whatever their names. Null keys and
repeated rows are rows like any other: the near-dedup stage alone leaves one row of each group. An empty table of
documents gives an empty one at every stage.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import language, lines, packing, secrets, simhash
from marlstone.llm.common import cut_folder, remove, table
from marlstone.llm.queries import END_ID, RANKS, SEQUENCE, TOKENIZER


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters in a language learned from the labelled ones; null and letterless texts go."""
    return language.keep_known(docs, language.labelled_text(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later occurrences of runs of lines of 50 words or more."""
    return _sized(lines.dedup_lines(docs, min_words=50))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of linked fingerprints."""
    return simhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return _sized(secrets.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document and its place in a training sequence."""
    return packing.pack_documents(docs, **RANKS, size=SEQUENCE, end_id=END_ID, tokenizer=TOKENIZER)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_copies),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

#: Stages of this pipeline go beyond SQL. Tests hold the rows of the whole against a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again.

    A stage's table is deleted when the next one is written; that of the last one, which the result reads, stays.
    """
    folder = f"{cut_folder(spark)}/pipeline-{uuid.uuid4().hex}"

    def step(docs: DataFrame, at: int) -> DataFrame:
        name, work = STAGES[at]
        work(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if at:
            remove(spark, f"{folder}/{STAGES[at - 1][0]}")
        return spark.read.parquet(f"{folder}/{name}")

    return reduce(step, range(len(STAGES)), table(spark, sf_dir, "documents"))
