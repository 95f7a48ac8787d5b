"""File corpora: recursive scans, manifests, and text tables as contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _own(path: Column) -> Column:
    """A local file's path without its scheme."""
    return F.regexp_replace(path, r"^file:/+(?=[^/])", "/")


def scan_files(spark: SparkSession, paths: list[str] | str, min_size: int | None = None, max_size: int | None = None) -> DataFrame:
    """path, size, modified, content of all files below paths. Size bounds reach the scan, so other files are not read."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        return spark.createDataFrame([], "path string, size long, modified timestamp, content binary")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    if min_size is not None:
        df = df.filter(F.col("length") >= min_size)
    if max_size is not None:
        df = df.filter(F.col("length") <= max_size)
    return df.select(_own(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def manifest_paths(spark: SparkSession, manifests: list[str] | str) -> list[str]:
    """The paths that manifests name, one a line; blank lines are passed over. A manifest lists inputs, so it is small."""
    rows = spark.read.text(manifests).select(F.trim("value").alias("p")).filter("p <> ''").collect()
    return [r["p"] for r in rows]


def expand_inputs(spark: SparkSession, paths: list[str], path_list: bool = False) -> list[str]:
    return manifest_paths(spark, paths) if path_list else list(paths)


def text_contents(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """A table of texts as contents: external_id and the UTF-8 bytes. Null texts are no documents."""
    return df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("external_id"), F.encode(F.col(text_col), "UTF-8").alias("content"))
