"""The registered queries of this subpackage's operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesift.llm import ann, html, langid, linededup, mixing, packing, sharding, simhash, tokencount, topk
from bytesift.llm.common import fresh_dir, read

#: Distinct sites from which a line counts as boilerplate.
MIN_SITES = 10


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_documents(read(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), ["doc_id"])


def op4_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs.withColumn("held_out", langid.held_out(F.col("doc_id"))), langid.fit(docs), ["doc_id", "held_out"])


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, scale=1024.0, k=10)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return tokencount.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), fresh_dir(spark, "token-counts"), limit=4096)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, "documents"), shingle=4, max_bits=4).select("doc_id", "fingerprint", "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.dedup_lines(docs, min_sites=MIN_SITES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_packing, op3_sharding, op4_additive_ann, op5_language_id, op6_exact_topk, op7_token_counts, op8_main_text, op9_simhash, op10_line_dedup)
}
SQL: dict[str, str] = {"op10_line_dedup": linededup.SQL.format(min_sites=MIN_SITES)}
