"""Token counts through a digest cache.

A text's normalised content and the tokenizer's version each have a digest; counts are stored under the pair.
A count joins the digests to the stored ones, encodes each missing content once, appends the new counts to the
cache and joins again, so copies and earlier runs cost a hash and no encoding. Digests move, texts do not: a missing
content is encoded where the first row that has it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesift.llm.common import among, bounded_batches, cut
from bytesift.llm.encoders import count_many, tokenizer_digest

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"


def content_digest(text: Column) -> Column:
    """SHA-256 of the normalised content. Null counts as the empty text; nothing else changes, as it would change counts."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty table where there is no cache yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def _encode(path: str):
    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"content": b["content"], "n_tokens": count_many(path, b["text"].tolist())})

    return counts


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row of docs, in no order.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows each get a row; a null id stays null. Very long
    texts are encoded whole. Other columns of docs are not read, whatever their names. An empty table gives an
    empty result. The cache only ever grows by rows, each written once its count is known; a run that dies leaves a
    valid cache. Two runs at once may both append a count; equal pairs are read as one. docs must be a deterministic scan
    (files), for rows are found again by their place in it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    version = tokenizer_digest(tokenizer_path)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    keyed = cut(texts.select("id", "rid", F.octet_length("text").cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("content")))

    def known() -> DataFrame:
        rows = read_cache(spark, cache_path).filter(F.col("tokenizer") == version)
        return rows.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))

    misses = keyed.groupBy("content").agg(F.min("rid").alias("rid")).join(known().select("content"), "content", "left_anti")
    missing = among(texts.select("rid", "text"), "rid", cut(misses.select("rid")))
    counted = missing.select(content_digest(F.col("text")).alias("content"), "text").mapInPandas(_encode(tokenizer_path), "content binary, n_tokens long")
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    # No aggregation stands between the cache and the join, so a digest that many rows share can be split there.
    now = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).select("content", "n_tokens")
    if _repeats(now):
        now = known()
    return keyed.join(now, "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _repeats(counts: DataFrame) -> bool:
    """Whether concurrent runs have stored a count twice."""
    a = counts.agg(F.count("*").alias("n"), F.count_distinct("content").alias("d")).first()
    return a["n"] != a["d"]
