"""Corpus pipeline: language, near duplicates, benchmark leaks, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of ``documents``.

Rows without a text or with an empty one name no language and go in the first
stage, and so does what no learned language explains. A null doc_id is an id
like any other; of equal texts the smallest doc_id stays (null first), and one
row of those that repeat it. Texts of any length are worked on as a whole.
Further columns pass through whatever their names. An empty table gives no
rows; null items of the benchmark match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import decontaminate, jaccard, langid, packing, pii
from gridloom.llm.common import stage, temporaries


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those that the evidence rejects go."""
    found = langid.identify(docs, declared="lang", host="source")
    return found.filter("accepted").select(*[F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest doc_id."""
    return jaccard.representatives(docs, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of personal data replaced by its kind."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row per piece of a document."""
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("best-fit packing", pack),
]

#: Hashing, a latent space and a tokenizer decide: SQL can't express them; tests/llm/test_pipeline.py compares run() with a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return step(spark, docs, sf_dir)
        # what a stage leaves behind goes once its result is written
        with temporaries() as keep:
            docs = keep(stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-")))
    return docs
