"""Streams of contents into a table: each micro-batch is one commit, so a search sees whole batches only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bytesift.operators.maintenance import insert, merge_folders
from bytesift.sources.store import Store


def file_stream(spark: SparkSession, path: str, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """New files below a folder as contents. max_files bounds a batch, which holds back a source that is too fast."""
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(F.regexp_replace("path", r"^file:/+(?=[^/])", "/").alias("external_id"), "content")


def table_stream(spark: SparkSession, path: str, id_col: str, text_col: str, max_files: int | None = None) -> DataFrame:
    """New Parquet files of a table of texts as contents."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("external_id"), F.encode(text_col, "UTF-8").alias("content"))


def ingest_stream(stream: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts the ingest. A batch that is repeated after a failure finds its documents there and adds nothing.

    Folders of batches are merged as they become many, so searches and later batches don't slow down with their number. One writer at a time holds the checkpoint. trigger: {"availableNow": True} or {"processingTime": ...}.
    """

    def batch(df: DataFrame, number: int) -> None:
        insert(store, df)
        merge_folders(store)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
