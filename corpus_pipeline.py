"""From raw documents to packed training sequences, each stage on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Stages are written as Parquet and read again in between, so a lost executor costs
part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm import language_spans, packing, raking, simhash, suffix_trees
from turnledger.session import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of the tokens that the mixture keeps, whatever the scarcest source or language has.
MIXED = 2 / 3
#: Jaccard similarity of five-word shingles from which documents are near copies.
SIMILAR = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets the language found in it; those without letters or of an unlearned script go."""
    model = language_spans.with_unlearned(language_spans.train_on_rest(docs))
    found = language_spans.with_language(docs, model).filter(F.col("language.lang") != language_spans.NONE)
    return found.withColumn("lang", F.col("language.lang")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return simhash.one_of_each(docs, similar=SIMILAR).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the first document that has them; emptied documents go."""
    found = suffix_trees.dedup_passages(docs.select(*COLUMNS)).filter("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    chars = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", chars).withColumn("text", F.col("kept")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two thirds of the tokens are drawn, as near to the target shares of sources, languages and topics as they allow."""
    return raking.mix(docs, keep=MIXED).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into training sequences of the permitted lengths."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("passages", passages), ("mixture", mixture),
    ("sequences", sequences),
]

#: Fingerprints, Viterbi and greedy packing have no SQL form; tests/llm/test_pipeline.py compares by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
