"""The corpus pipeline: classify, clean, drop near copies, replace personal data, pack.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns
a DataFrame, which is written as Parquet and read again as the next one's
``docs``.  All stages but the last return the columns of ``documents``.

Defined results: a stage keeps rows with a null text only if its operator does
(the classifier scores them as empty; the line rules reject them); repeated rows
are one document, of which one row stays after the near-copy stage; an empty
table passes through all stages; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import jaccard_join, line_rules, packing, pii, quality_classifier
from rosterloom.llm.common import Scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be of quality 1."""
    return quality_classifier.accepted_documents(docs, table(spark, sf_dir, "labels"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line rules, without the lines that fail them."""
    return line_rules.clean_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by the n-gram Jaccard join."""
    return jaccard_join.representatives(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and n_chars counted anew."""
    replaced = pii.replace_entities(docs)
    text = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return replaced.select(*(text.get(c, F.col("kept").getField(c)).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_quality_rules),
    ("jaccard_join", drop_near_copies),
    ("pii_surrogates", replace_personal_data),
    ("packing", pack_sequences),
]

#: No SQL: training, tokenising and packing can't be said in it; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
