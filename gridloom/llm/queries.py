"""Registered queries of the training-data operators, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, jaccard, knn, langid, packing, pii, quality, substrings, training_order, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), threshold=0.8).select("doc_id", "class_id", "n_links")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.identify(documents, keep=["doc_id"], declared="lang", host="source")


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language ID where markup declares the language and addresses give suffixes and hosts."""
    pages = table(spark, sf_dir, "pages").withColumn("text", langid.plain_text("html"))
    return langid.identify(pages, keep=["page_id"], markup="html", address="url")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.fit(documents, table(spark, sf_dir, "labels"), "quality"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, folder = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_records(members, folder)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    written, folder = training_order.materialise(table(spark, sf_dir, "documents"))
    return training_order.read_slots(written, folder).drop("file")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_pii, op3_language_id, pages_language_id, op4_best_fit_packing, op5_quality, op6_substring_dedup, op7_benchmark_decontamination, op8_warc, op9_exact_top_k, op10_training_order)}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_warc": """
            with p as (select page_id, encode(coalesce(html, '')) as body from pages),
            d as (select page_id, octet_length(body) as payload_bytes, sha256(body) as payload_digest from p),
            f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first_id from d)
            select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
                   case when page_id > first_id then 'revisit' else 'response' end as record_type,
                   case when page_id > first_id then first_id end as refers_to
            from f
        """,
        "op9_exact_top_k": """
            with v as (
                select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
                where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
            ),
            s as (
                select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
                from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
            ),
            r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from s)
            select query_id, cast(place as int) as rank, vec_id, score from r where place <= 5
        """,
    }
