"""Queries of this subpackage over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    importance, langid, packing, periodic_runs, piece_sampling, quality_rank, quality_rules, sharding, simhash, sql, syncmers, token_store, topk,
    url_filter,
)
from .common import read_table, scratch_path
from .tokens import default_tokenizer

SHARDS = 8


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the groups that they link."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents by fused evidence, with the source as host."""
    return langid.identify(read_table(spark, sf_dir, "documents"), host=F.col("source"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fusion for web pages, which have a markup language and an address."""
    pages = read_table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ").alias("text"),
        F.nullif(F.regexp_extract("html", r"<html[^>]*\blang=\"([A-Za-z]+)", 1), F.lit("")).alias("markup"),
        "url",
    )
    found = langid.identify(pages, "page_id", "text", "markup", url_filter.url_host(F.col("url")))
    return found.withColumnRenamed("doc_id", "page_id")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written and read back, as digests."""
    path = scratch_path(spark, "token-store")
    encoded = token_store.encode_documents(read_table(spark, sf_dir, "documents"), default_tokenizer())
    token_store.write_store(encoded, path)
    return token_store.ids_digest(token_store.read_store(spark, path))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then reputation; the outcome of a page is the quality label of equal number."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    outcomes = pages.join(labels, "page_id").select(url_filter.url_host(F.col("url")).alias("host"), "good")
    return url_filter.filter_urls(pages, outcomes)


def op4_url_filter_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier name of op4_url_filter, whose hosts without outcomes now always inherit."""
    return op4_url_filter(spark, sf_dir)


def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, decoded again."""
    return piece_sampling.sampled_round_trip(read_table(spark, sf_dir, "documents"), piece_sampling.default_model())


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences, as digests."""
    return packing.piece_digests(packing.pack_documents(read_table(spark, sf_dir, "documents"), default_tokenizer()))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 greatest inner products of every twentieth vector with all others."""
    return topk.exact_top_k(topk.quantized(read_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and fences of language and source for all documents."""
    judged = quality_rules.judge_documents(read_table(spark, sf_dir, "documents"))
    return judged.withColumn("broken", F.concat_ws(",", "broken"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of all documents by jump hashing of the id."""
    rows = sharding.shard_documents(read_table(spark, sf_dir, "documents"), SHARDS)
    return rows.withColumn("law", F.lit("key"))


def op10_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learnt from pairs of labelled ones."""
    docs = read_table(spark, sf_dir, "documents")
    return quality_rank.score_documents(docs, quality_rank.fit(docs, read_table(spark, sf_dir, "labels")))


def op11_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, with likenesses."""
    return syncmers.edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's texts, with weights and ranks."""
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, of which one in ten is looped first."""
    return periodic_runs.find_runs(read_table(spark, sf_dir, "documents"), loops=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_simhash,
        op2_language_id,
        op3_token_store,
        op4_url_filter,
        op4_url_filter_inherited,
        op5_piece_sampling,
        op6_packing,
        op7_exact_top_k,
        op8_quality_rules,
        op9_sharding,
        op10_quality_rank,
        op11_syncmers,
        op12_resampling,
        op13_periodic_runs,
        language_id_pages,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    same = {"op4_url_filter": sql.OP4_SQL, "op4_url_filter_inherited": sql.OP4_SQL}
    return same | {"op7_exact_top_k": sql.OP7_SQL, "op8_quality_rules": sql.OP8_SQL}
