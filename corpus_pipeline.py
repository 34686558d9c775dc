"""A corpus pipeline of five stages; each reads all that the one before kept.

Documents whose language is rejected go; of near copies (five-word shingles, a similarity of 0.8 and more) one
stays; secrets are masked; sources are mixed to target weights (a document may then come twice); what is left is
encoded to pieces, and decoded to check it.

Defined results: a null text, or one without a letter, is rejected by the first stage; rows without a source are a
source of their own, rows without an id are mixed and deduplicated like any other; of repeated rows and of ties one
row stays, that of the least id; a text of any length is read whole by every stage; an empty table gives an empty
result; other columns of the documents come through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderweave.llm import language_id, piece_tokens, secret_scan, simhash_dedup, source_mixing
from orderweave.llm.common import Scratch, table

WEIGHTS = [3, 1, 2]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents whose language is told with enough certainty, by a model of the labelled ones among them."""
    return language_id.drop_rejected(docs, language_id.fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_dedup.drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars set to what is left."""
    return secret_scan.redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return source_mixing.mix_documents(docs, WEIGHTS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces."""
    return piece_tokens.encode_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
