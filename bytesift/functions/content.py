"""Columns over file contents that stay in the JVM, and the two that need Python."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytesift.functions.bloom import estimated_grams, grams_of
from bytesift.functions.fields import BOOLEANS, INTEGERS, column_name
from bytesift.functions.headers import entropy, header_fields

#: The struct of header fields as a type; a type needs no session.
META_TYPE = T.StructType(
    [
        *(T.StructField(column_name(f), T.BooleanType()) for f in BOOLEANS),
        *(T.StructField(column_name(f), T.ArrayType(T.LongType())) for f in INTEGERS),
        T.StructField("pe_entry_point", T.LongType()),
        T.StructField("pe_entry_bytes", T.BinaryType()),
    ]
)


#: Contents and bytes of one Arrow batch; they bound what a Python worker holds. A longer content travels alone.
BATCH_CONTENTS, BATCH_BYTES = 128, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to so many contents and bytes; smaller settings stay as they are."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_CONTENTS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def latin1(content: Column) -> Column:
    """Bytes as text, one character a byte; nothing is lost."""
    return F.decode(content, "ISO-8859-1")


def digest(content: Column, kind: str) -> Column:
    """The lower-case hexadecimal digest of a content."""
    return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512)}[kind](content)


def binary(data: bytes) -> Column:
    return F.lit(bytearray(data))


def little_endian(content: Column, offset: Column | int, width: int) -> Column:
    """An unsigned number of up to 7 bytes at a byte offset; null beyond the end."""
    start = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    part = F.substring(content, start.cast("int"), F.lit(width))
    return F.when(F.octet_length(part) == width, F.conv(F.hex(F.reverse(part.cast("binary"))), 16, 10).cast("long"))


def file_prefix(content: Column, n: int = 8) -> Column:
    return F.substring(content, 1, n)


@F.pandas_udf(T.FloatType())
def entropy_of(contents: pd.Series) -> pd.Series:
    """Exact byte entropy in bits a byte."""
    return pd.Series([None if c is None else entropy(bytes(c)) for c in contents], dtype="float32")


@F.pandas_udf(META_TYPE)
def headers_of(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The struct of header fields of each content."""
    for batch in contents:
        yield pd.DataFrame([header_fields(bytes(c) if c is not None else b"") for c in batch])


def distinct_grams_of(content: Column, n: int) -> Column:
    """The number of distinct runs of n bytes."""

    @F.pandas_udf("long")
    def count(contents: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else len(grams_of(bytes(c), n)) for c in contents], dtype="Int64")

    return count(content)


def estimated_grams_of(content: Column, n: int) -> Column:
    """About the number of distinct runs of n bytes, within some percent, in bounded memory."""

    @F.pandas_udf("double")
    def count(contents: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else estimated_grams(bytes(c), n) for c in contents], dtype="float64")

    return count(content)


entropy_of = entropy_of.asNondeterministic()
headers_of = headers_of.asNondeterministic()
