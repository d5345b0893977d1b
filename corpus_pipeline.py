"""From raw documents to packed training windows, in five stages.

Every stage reads all that the stage before it kept. Part of ``pelorus.llm``.

In all stages an empty table gives none, null and empty texts do no harm (the
first stage drops them, as they hold no letter, the others but the mix keep
them), rows that repeat are documents of their own until the second stage keeps
one of them, other columns may have any name and pass through, and texts are
taken whole. Ties go to the smaller doc_id; rows without doc_id stay without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pelorus.llm import language_id, mixing, ngram_join, packing, secrets
from pelorus.llm.common import read, stage
from pelorus.llm.queries import vocabulary_file


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and such that resemble none of the corpus's own languages."""
    return language_id.keep_known(docs, language_id.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group with 5-word shingle similarity of 0.8 or more."""
    return ngram_join.deduplicate(docs, width=5, num=80, den=100)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets that a ledger scan finds; every document stays."""
    return secrets.without_secrets(docs, secrets.new_ledger(spark))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take words of each source near its target weight, in blocks; a row for each pass over a document."""
    return mixing.mixed_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts into windows of 2048 tokens: a row for each piece."""
    return packing.pack(docs, vocabulary_file(), window=2048, end_id=1)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard", one_of_each),
    ("secret_scan", masked_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: The language model, the mix's permutations and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored before the next one reads them."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
