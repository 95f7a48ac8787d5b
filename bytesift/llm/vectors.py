"""What vector searches share: vectors as bytes, copies as one candidate, a grid of query blocks and row shards."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytesift.llm.common import bounded_batches, cut

#: Vectors that a model or a rotation is fitted on, at most.
SAMPLE = 16_384


def packed(vectors: DataFrame, id_col: str, vector_col: str, zeros: bool) -> tuple[DataFrame, type]:
    """rid, vec_id and v, the components as bytes, of each vector that takes part, and the type of the components.

    Null vectors take no part, nor do those with null or non-finite components and, unless zeros, those without any other than zero.
    """
    bounded_batches(vectors.sparkSession, 4096)
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    kind = np.float32 if single else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(2).is_valid())
            own = pc.fill_null(b.column(2).flatten(), float("nan")).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))]).astype(np.int64)
            count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])  # noqa: E731, B023
            takes = (count(~np.isfinite(own)) == 0) & (zeros | (count(own != 0) > 0))
            size = np.diff(ends)
            kept = own[np.repeat(takes, size)].astype(kind) + kind(0)  # -0.0 is 0.0
            places = np.concatenate([[0], np.cumsum(size[takes])]).astype(np.int32) * kept.itemsize
            v = pa.Array.from_buffers(pa.binary(), int(takes.sum()), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(kept)])
            out = b.filter(pa.array(takes))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), v], names=["rid", "vec_id", "v"])

    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    return cut(rows.mapInArrow(pack, f"rid long, vec_id {dict(rows.dtypes)['vec_id']}, v binary")), kind


def matrix(blobs: Iterable[bytes], dims: int, kind: type) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are padded with zeros, which changes no inner product."""
    blobs = list(blobs)
    size = dims * np.dtype(kind).itemsize
    return np.frombuffer(b"".join(b if len(b) == size else b.ljust(size, b"\0") for b in blobs), kind).reshape(len(blobs), dims).astype(float)


def dimensions(rows: DataFrame, kind: type) -> int:
    return max(1, (rows.agg(F.max(F.octet_length("v"))).first()[0] or 0) // np.dtype(kind).itemsize)


def groups(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Copies of a vector as one candidate: heads (gid, vec_id, v), one a vector, and members (gid, rid, vec_id).

    Of copies only the k + 1 with the smallest ids (null last) can be among the k nearest of a row, itself left out; the head is the first of them.
    """
    first = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last(), "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumn("place", F.row_number().over(first)).withColumn("gid", F.first("rid").over(first)).filter(F.col("place") <= k + 1)
    own = cut(own.select("gid", "rid", "vec_id", "place", F.when(F.col("place") == 1, F.col("v")).alias("v")))
    return own.filter("place = 1").select("gid", "vec_id", "v"), own.select("gid", "rid", "vec_id")


def sample(rows: DataFrame, most: int = SAMPLE, share: float = 1.0) -> list[bytes]:
    """v of at most about `most` rows (gid, v) and about that share of them, drawn by a hash, in one order."""
    share = min(share, most / max(1, rows.count()))
    drawn = rows.filter(F.pmod(F.xxhash64("gid", F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("gid", "v").toPandas()
    return [bytes(v) for v in drawn.sort_values("gid")["v"]]


def grid(rows: DataFrame, queries: DataFrame, shard_rows: int, block_queries: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cells (shard, block) in which each row (gid) meets each query (qid) once; a task holds one cell."""
    n, q = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-q // block_queries))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    x = rows.withColumn("shard", F.pmod(F.xxhash64("gid"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    y = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    return x, y


def best(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest score of each query but itself, ties to the smaller vec_id (null last).

    found: qid, query_id, gid, vec_id (of the head), score. Groups behind the first k + 1 by score and head hold none of the k.
    """
    by = lambda *last: Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), *last)
    near = found.withColumn("rank", F.row_number().over(by("gid"))).filter(F.col("rank") <= k + 1).select("qid", "query_id", "gid", "score")
    rows = near.join(members, "gid").filter("rid <> qid")
    return rows.withColumn("rank", F.row_number().over(by("rid"))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
