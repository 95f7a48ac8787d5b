"""The corpus pipeline: documents -> language ID -> line dedup -> near-dedup -> mix -> packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Its result is written as Parquet
and read again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesift.llm import langid, linededup, mixing, packing, simhash
from bytesift.llm.common import fresh_dir, remove
from bytesift.llm.queries import MIN_SITES

#: Mean probability below which no language is recognised.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no recognised language: null texts, texts without a letter, texts below LEAST_SCORE.

    The network learns from the labelled rows of docs that aren't held out. Without any it rejects nothing but the
    null and letterless texts. Very long texts are read whole; repeated rows have the same fate; an empty table stays empty.
    """
    model = langid.fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return langid.recognised(docs, model, LEAST_SCORE)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes all but the first occurrence of lines on MIN_SITES sources or more; n_chars follows the text.

    Every row stays, with an empty text if it had no other line; a null text stays null and has no n_chars. Null sources are one site. Long
    texts are read whole; an empty table stays empty.
    """
    out = linededup.dedup_lines(docs, min_sites=MIN_SITES)
    size = F.char_length("text").cast(dict(docs.dtypes).get("n_chars", "long"))
    return out.select(*[(size.alias(c) if c == "n_chars" else F.col(f"`{c}`")) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates - five-word shingles, similarity of 0.8 or more - the smallest doc_id stays.

    Null ids come last, and of equal ids one row stays. Null texts and texts without words are one group. Long texts are read whole; an
    empty table stays empty.
    """
    return simhash.near_duplicates_dropped(docs, shingle=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it.

    A null source is a source; null texts have no words; ties are broken by a hash of the row. An empty table stays empty.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences of at most 1024 tokens.

    A null text is the end id alone; rows with equal or null ids are packed each for itself; long texts are cut. An empty table gives no
    sequences.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the network nor the sampling nor the tokenizer; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is removed once the next one is written; the last one's is what is returned."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        at = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)
        before = at
    return docs
