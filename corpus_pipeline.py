"""From raw documents to training sequences: toxicity, language, near copies, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept. All but the last return the
columns of ``docs``; extra columns pass through. Each works with the operator of its name in
``soundpairs.llm``, which states what happens to nulls, empty texts and repeated rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundpairs.llm import lang_id, near_dup, packing, suffix_dedup, toxicity
from soundpairs.llm.common import reachable, small_batches, table
from soundpairs.session import settled


_OWN = ("doc_id", "text", "lang", "source", "n_chars")


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """Other columns of ``docs`` get names that no operator uses, and their own back in the result."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        reachable(spark)
        small_batches(spark)
        names = [c if c in _OWN else f"extra_{i}" for i, c in enumerate(docs.columns)]
        out = fn(spark, docs.toDF(*names), sf_dir)
        return out.toDF(*docs.columns) if out.columns == names else out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier doesn't predict to be toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, docs.columns).where("predicted = 0").select(*docs.columns)


@stage
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a centroid of some language."""
    model = lang_id.fit(docs, ~lang_id.held_out(F.col("doc_id")))
    return lang_id.predict(docs, model, docs.columns).where("not rejected").select(*docs.columns)


@stage
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of 5-word shingles 0.85 and more) the row with the smallest doc_id.

    Rows are told apart by doc_id and text; all rows without a doc_id, or without a word, stay.
    """
    return near_dup.keep_one(docs)


@stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur again; n_chars follows. A character that loses a byte goes."""
    done = suffix_dedup.remove_repeats(docs, docs.columns)
    cut = F.col("n_removed") > 0
    out = done.withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and its place there."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_languages),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("suffix-array dedup", drop_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: Trained models, suffix arrays and packing are beyond SQL. Tests hold the near-copy, passage and packing stages against
#: brute force, and the two learned stages against their operators, whose accuracy on held-out rows is tested.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settled(docs)
    return docs
