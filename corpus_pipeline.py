"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All
but the last return the columns of ``documents``. SQL cannot express the first stage's
estimation, so ``ORACLE_SQL`` is None and the tests hold the run against brute force.

Defined cases: a null or empty text has too few words and goes in the first stage; so does
any text under 50 words. Of repeated rows, as of any group of near copies, the second stage
keeps one, with the smallest doc_id, nulls last. Very long texts are read whole in every
stage and cut into 1024-token pieces in the last. Columns beyond those of ``documents``
pass through all stages but the last, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfield.llm import common, decontaminate, jaccard, packing, pseudonyms, quality

ORACLE_SQL = None
MEMO_ENTRIES = 60_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rules' votes, weighed by estimated accuracies, speak for them."""
    return quality.keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: five words, similarity 0.8 or more."""
    return jaccard.keep_one(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are benchmark windows."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal numbers, dates and addresses."""
    out = pseudonyms.with_pseudonyms(docs, pseudonyms.session_key(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences of 1024."""
    # Worker processes live on between stages and runs, so this one's memory of words is small and goes with its task.
    return packing.pack(docs, memo_entries=MEMO_ENTRIES, forget=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again by the next.

    Then all other tables that this application left in the shared folder are removed.
    """
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.clean_up(spark, keep=docs)
    return docs
