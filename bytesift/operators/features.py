"""From contents to index rows: digests, sizes, filters, header fields, entropy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from bytesift.functions.bloom import build, grams_of
from bytesift.functions.content import META_TYPE, bounded_batches, digest, file_prefix
from bytesift.functions.headers import META_DDL, entropy, header_fields, is_special
from bytesift.plans.policy import Policy


def feature_rows(contents: DataFrame, policy: Policy) -> DataFrame:
    """The index row of each content (external_id, content), but for its place in the table.

    Digests, sizes and prefixes are computed in the JVM; one pass in Python makes both filters, the entropy and the
    header fields. Null contents are no documents; empty ones have empty filters.
    """
    bounded_batches(contents.sparkSession)
    (n1, n2), k1, k2 = policy.grams, policy.bits(1), policy.bits(2)

    meta_type = to_arrow_schema(META_TYPE)

    def words(filters: list[np.ndarray]) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in filters])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(filters) if filters else np.zeros(0, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents = [c.as_py() for c in b.column("content")]
            first = [build(grams_of(c, n1), k1) for c in contents]
            second = [build(grams_of(c, n2), k2) for c in contents]
            fields = [header_fields(c) for c in contents]
            meta = pa.StructArray.from_arrays([pa.array([f[t.name] for f in fields], t.type) for t in meta_type], fields=list(meta_type))
            made = {
                "special_population": pa.array([is_special(c) for c in contents], pa.bool_()),
                "t1_words": words([f[0] for f in first]), "t1_log2": pa.array([f[1] for f in first], pa.int32()),
                "t2_words": words([f[0] for f in second]), "t2_log2": pa.array([f[1] for f in second], pa.int32()),
                "entropy": pa.array([entropy(c) for c in contents], pa.float32()), "meta": meta,
            }
            kept = {c: b.column(c) for c in b.schema.names if c != "content"}
            yield pa.RecordBatch.from_arrays([*kept.values(), *made.values()], names=[*kept, *made])

    meta = ", ".join(p.replace(" ", ":", 1) for p in META_DDL.split(", "))
    c = F.col("content")
    rows = contents.filter(c.isNotNull()).select(digest(c, policy.id_source).alias("identity_hex"), F.octet_length(c).cast("long").alias("file_size"), F.col("external_id").cast("string"), file_prefix(c).cast("binary").alias("prefix8"), "content")
    return rows.mapInArrow(run, f"identity_hex string, file_size long, external_id string, prefix8 binary, special_population boolean, t1_words array<long>, t1_log2 int, t2_words array<long>, t2_log2 int, entropy float, meta struct<{meta}>")


def shard_of(identity_hex, shards: int):
    """The first four bytes of the identity as a little-endian number, modulo the number of shards."""
    le = F.concat(*[F.substring(identity_hex, i, 2) for i in (7, 5, 3, 1)])
    return F.pmod(F.conv(le, 16, 10).cast("long"), F.lit(shards)).cast("int")
