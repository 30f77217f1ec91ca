"""Queries p2, p6, p8, p9 and p10, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import load
from .digest import group_key, merge_digests, partial_digests, percentiles
from .encode import count_tokens, decode_corpus, encode_corpus
from .names import all_mentions, found, link_names
from .packing import pack
from .splitting import split_texts


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, load(spark, d, "extracted_claims"), load(spark, d, "entity_mapping_versions"), load(spark, d, "given_name_forms"))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per mention with its entity's least mention and its number of links."""
    linked = link_names(all_mentions(load(spark, d, "extracted_claims"), load(spark, d, "entity_mapping_versions")), load(spark, d, "given_name_forms"))
    of = linked.groupBy("entity").agg(F.min("mention").alias("first_mention"), (F.count("*") - 1).alias("links"))
    return linked.join(of, "entity").select("mention", "first_mention", "links")


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(load(spark, d, "saved_null_observations_v1"), ["transition_id", "bucket_id"], "noise_displacement")


def p6_combined(spark: SparkSession, d: str) -> DataFrame:
    """Digests of each endpoint snapshot, made separately, combine per transition and bucket."""
    t = load(spark, d, "saved_null_observations_v1")
    g = group_key("transition_id", "bucket_id")
    portion = merge_digests(partial_digests(t, F.concat_ws("\u0001", g, F.coalesce("endpoint_snapshot", F.lit(""))), "noise_displacement"))
    return percentiles(t, ["transition_id", "bucket_id"], "noise_displacement", digests=merge_digests(portion.withColumn("g", F.split("g", "\u0001")[0])))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(load(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return decode_corpus(encode_corpus(load(spark, d, "documents")))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(count_tokens(load(spark, d, "documents")), "doc_id", "n_tokens")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(load(spark, d, "documents")).drop("row")


def p10_joined(spark: SparkSession, d: str) -> DataFrame:
    """The cores of each document's pieces put together again: the text."""
    p = split_texts(load(spark, d, "documents"))
    own = F.expr("substring(piece_text, core_start - start + 1, core_end - core_start)")
    parts = p.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("core_start", "core_end", own.alias("t")))).alias("c"), F.max(F.col("piece_text").isNotNull()).alias("there"))
    return parts.select("doc_id", F.when(F.col("there"), F.array_join(F.transform("c", lambda x: x["t"]), "")).alias("text"))


QUERIES = {f.__name__: f for f in (p2_found, p2_entities, p6_percentiles, p6_combined, p8_ids, p8_decoded, p9_containers, p10_pieces, p10_joined)}

SQL: dict[str, str] = {
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p10_joined": "SELECT doc_id, text FROM documents",
}
