"""Sharding through a permutation-filled lookup table.

Each shard has an order of preference over the slots of a table of prime size. Shards take turns, each claiming the
first slot in its order that is free, until the table is full. A row's key hashes to a slot and the slot names the
shard; the table has a fixed size and is broadcast. When a shard comes or goes, most slots keep their shard.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesift.llm.common import free_name, with_row_id

#: Slots of the table, a prime; a table of two ints a slot takes about half a MB and is what a query broadcasts.
SLOTS = 65_537
SHARDS = 64
#: Bytes of rows in one file of a shard.
FILE_BYTES = 512 << 20


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


@lru_cache(maxsize=8)
def lookup_table(names: tuple[str, ...], slots: int = SLOTS) -> np.ndarray:
    """For each slot the index of its shard. names: the shards, distinct; slots: a prime, larger than their number by far."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need distinct names, and at least one")
    if slots <= len(names) or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime above the number of shards")
    offset = [_hash(n, "offset") % slots for n in names]
    skip = [_hash(n, "skip") % (slots - 1) + 1 for n in names]
    table = np.full(slots, -1, np.int32)
    following, claimed = [0] * len(names), 0
    while claimed < slots:
        for i in range(len(names)):
            while True:
                slot = (offset[i] + following[i] * skip[i]) % slots
                following[i] += 1
                if table[slot] < 0:
                    break
            table[slot] = i
            claimed += 1
            if claimed == slots:
                break
    return table


def slot_of(keys: list[Column], slots: int = SLOTS) -> Column:
    """The slot of a row's key. A null key column is passed over by the hash, so null keys share a slot."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, names: tuple[str, ...], slots: int = SLOTS) -> DataFrame:
    rows = [(i, int(s), names[s]) for i, s in enumerate(lookup_table(names, slots))]
    return spark.createDataFrame(rows, "slot int, shard int, shard_name string")


def shard(df: DataFrame, keys: list[str], names: tuple[str, ...] = tuple(f"shard-{i:03d}" for i in range(SHARDS)), slots: int = SLOTS) -> DataFrame:
    """df with slot, shard and shard_name (underscores before them if df has such columns).

    Rows with equal keys share a shard; choose keys that tell rows apart where one value may hold many rows. Null keys
    are a key like any other. Every row stays, in place: no shuffle. No rows give no rows.
    """
    own = {c: free_name(df, c) for c in ("slot", "shard", "shard_name")}
    table = table_frame(df.sparkSession, names, slots)
    for c, name in own.items():
        table = table.withColumnRenamed(c, name)
    return df.withColumn(own["slot"], slot_of([F.col(k) for k in keys], slots)).join(F.broadcast(table), own["slot"]).select(*[F.col(f"`{c}`") for c in df.columns], *own.values())


def _bytes(df: DataFrame) -> Column:
    """About the bytes of a row: those of its texts, and eight for each other column."""
    long = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    sizes = [F.coalesce(F.octet_length(F.col(f"`{c}`")).cast("long"), F.lit(0)) for c in long]
    return sum(sizes, F.lit(8 * (len(df.columns) - len(long))).cast("long"))


def write_shards(df: DataFrame, keys: list[str], path: str, file_bytes: int = FILE_BYTES, **options) -> None:
    """df as Parquet with a folder for each shard, in files of about file_bytes of rows.

    Rows are dealt over the files of a shard by their place in df, so many rows of one key are many files and tasks, not one. Null
    keys are a key; very long texts are rows like any other; no rows leave a folder without files; an existing path is an error and
    stays as it is. df must be a deterministic scan.
    """
    own = shard(with_row_id(df, free_name(df, "row_id")), keys, **options)
    rid, name = own.columns[len(df.columns)], own.columns[-2]
    files = own.groupBy(name).agg(F.greatest(F.ceil(F.sum(_bytes(df)) / file_bytes), F.lit(1)).alias("files"))
    dealt = own.join(F.broadcast(files), name)  # one row a shard
    dealt = dealt.withColumn("file", F.pmod(F.xxhash64(F.col(rid)), F.col("files")))
    total = files.agg(F.coalesce(F.sum("files"), F.lit(1))).first()[0]
    dealt.repartition(max(1, int(total)), name, "file").drop(rid, "files", "file").write.partitionBy(name).parquet(path)
