"""What the operators share: cutting lineage in the shared folder, scan-local row ids, bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python; whole texts travel in them, and a longer text travels alone.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
#: What separates words in the contracts: space, tab, LF, VT, FF, CR.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return str(jsc.getCheckpointDir().get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bytesift-"))
    return str(jsc.getCheckpointDir().get()).rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, rows: int | None = None, per_file: int = 50_000) -> DataFrame:
    """Computes df once into the reliable checkpoint folder; later reads survive the loss of executors.

    rows: how many there are at most, if that is known; then they go to a file for each per_file of them, and not to one for each
    partition of a shuffle.
    """
    spark = df.sparkSession
    at = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    done = (df if rows is None else df.coalesce(max(1, -(-rows // per_file)))).checkpoint(eager=True)
    # A checkpoint goes on with its plan's estimate of bytes, which multiplies with every join; after some steps of a loop
    # that number alone takes minutes. The rows as such have no estimate, and adaptive execution sees their sizes.
    rdd, schema = done._jdf.queryExecution().toRdd(), done._jdf.schema()
    return type(df)(spark._jsparkSession.internalCreateDataFrame(rdd, schema, False), spark)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batches to so many rows and to BATCH_BYTES; smaller settings stay as they are."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Adds a row id that is stable for as long as the same files are scanned in the same session."""
    return df.withColumn(name, F.monotonically_increasing_id())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this session has written, on whatever file system it is."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(own, True)


#: Bitmaps of 4 KB, one for each run of 32,768 row ids, that are broadcast at most: 64 MB.
BITMAPS = 1 << 14


def among(df: DataFrame, rid: str, ids: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of df whose row id is among ids (a column rid, one row an id), or is not.

    A bit for each row id goes to the rows of df, which stay where they are. Where there are more bitmaps than BITMAPS, the rows
    meet the ids in a shuffle.
    """
    bucket, bits = free_name(df, "bucket_"), free_name(df, "bits_")
    maps = ids.groupBy(F.bitmap_bucket_number(rid).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(rid)).alias(bits))
    maps = cut(maps, BITMAPS, BITMAPS // 8)
    if maps.count() > BITMAPS:
        return df.join(ids, rid, "left_semi" if inside else "left_anti")
    met = df.withColumn(bucket, F.bitmap_bucket_number(rid)).join(F.broadcast(maps), bucket, "left")
    place = F.bitmap_bit_position(rid)
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (place % 8).cast("int"))) != 0, F.lit(False))
    return met.filter(hit if inside else ~hit).select(*[F.col(f"`{c}`") for c in df.columns])


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it if df has such a column already (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
