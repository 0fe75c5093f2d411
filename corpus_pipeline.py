"""From raw documents to packed token sequences, as stages that each read what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskatlas.llm.catalog import EXAMPLE_KEY
from taskatlas.llm.contamination import decontaminate
from taskatlas.llm.packing import pack_documents
from taskatlas.llm.parity_join import one_of_each
from taskatlas.llm.pseudonyms import pseudonymize
from taskatlas.llm.toxicity import without_toxic
from taskatlas.plans.views import table
from taskatlas.sources.storage import stored

# Packing has no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below one half; null and empty texts are scored too, repeated rows alike."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return without_toxic(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, the one with the smallest id."""
    return one_of_each(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null and empty texts have none and stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values replaced by pseudonyms; ``n_chars``, where there is one, follows the text.

    Null texts stay null, empty and clean ones as they are; repeated rows repeat.
    """
    found = pseudonymize(docs, EXAMPLE_KEY)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; a null or empty text is one piece of one id."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), max_tokens=2048)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("contamination", contamination),
    ("private_values", private_values),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
