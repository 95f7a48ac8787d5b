"""Changes of a table: inserts, deletes, de-duplication, compaction, export and import. Each is one commit."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytesift.operators.features import feature_rows, shard_of
from bytesift.sources.store import DOCS, Store

PLACE = ["tree", "shard", "doc_id"]
#: Rows of a batch whose identities (64 bytes each) are broadcast.
SMALL_BATCH = 100_000
COLUMNS = ["identity_hex", "file_size", "external_id", "special_population", "t1_words", "t1_log2", "t2_words", "t2_log2", "prefix8", "entropy", "meta", *PLACE]


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def _stored(store: Store, state: dict, batch: DataFrame) -> DataFrame:
    """identity_hex and _live, whether a row of it is live, of the identities of a batch that are stored: one pass over the table.

    The identities of a small batch go to the table's rows, whose shards that the batch doesn't touch are not read; a large
    batch meets them in a shuffle.
    """
    asked = batch.select("identity_hex", shard_of(F.col("identity_hex"), store.policy().shards).alias("shard")).distinct()
    few = F.broadcast(asked) if batch.count() <= SMALL_BATCH else asked
    rows = store.all_docs(state).select("identity_hex", *PLACE).join(few, ["identity_hex", "shard"], "left_semi")
    if state["tombstones"]:
        gone = store.tombstones(state).select("tree", "doc_id").distinct().withColumn("_gone", F.lit(True))
        rows = rows.join(gone, ["tree", "doc_id"], "left")
    else:
        rows = rows.withColumn("_gone", F.lit(None).cast("boolean"))
    return rows.groupBy("identity_hex").agg(F.bool_or(F.col("_gone").isNull()).alias("_live"))


def insert_rows(store: Store, rows: DataFrame) -> DataFrame:
    """Appends index rows and tells each row's status: inserted, already_exists, or restored if it had been deleted.

    Rows with one identity are one document; the smallest external_id is kept. Document numbers go on from the last;
    each partition of the batch has a range of its own, so none is collected. Trees hold policy.tree_docs numbers each.
    """
    policy, (state, version) = store.policy(), store.state()
    folder = store.new_folder("incoming")
    rows.withColumn("_row", F.monotonically_increasing_id()).write.parquet(f"{store.root}/{folder}")  # computed once; statuses and rows come from it
    batch = store.spark.read.parquet(f"{store.root}/{folder}")
    # Copies of one content meet as partial results: equal identities have equal features, any row's will do.
    features = [c for c in COLUMNS if c not in ("identity_hex", "external_id", *PLACE)]
    keeper = F.min(F.struct(F.col("external_id").isNull().alias("none"), "external_id", "_row")).alias("keeper")
    one = batch.groupBy("identity_hex").agg(F.first(F.struct(*features)).alias("f"), keeper)
    status = F.when(F.col("_live"), "already_exists").when(F.col("_live").isNotNull(), "restored").otherwise("inserted")
    marked = one.join(_stored(store, state, batch), "identity_hex", "left").withColumn("status", status)
    fresh = marked.filter("status <> 'already_exists'").select("identity_hex", "keeper.external_id", "f.*")
    # Numbers: a row's place in its partition after the counts of the partitions before it.
    fresh = fresh.sortWithinPartitions("identity_hex").withColumn("_id", F.monotonically_increasing_id())
    numbered_at = store.new_folder("incoming")
    fresh.write.parquet(f"{store.root}/{numbered_at}")
    fresh = store.spark.read.parquet(f"{store.root}/{numbered_at}")
    part = F.shiftrightunsigned("_id", 33)
    counts = fresh.groupBy(part.alias("_part")).agg(F.count("*").alias("c"))
    starts = counts.withColumn("_start", F.sum("c").over(Window.orderBy("_part")) - F.col("c") + state["next_doc_id"]).drop("c")
    fresh = fresh.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row a partition
    fresh = fresh.withColumn("doc_id", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1))
    fresh = fresh.withColumn("tree", F.floor(F.col("doc_id") / policy.tree_docs).cast("int")).withColumn("shard", shard_of(F.col("identity_hex"), policy.shards))
    if not policy.store_path:
        fresh = fresh.withColumn("external_id", F.lit(None).cast("string"))
    target = store.new_folder("docs")
    _columns(fresh).write.partitionBy("tree", "shard").parquet(f"{store.root}/{target}")
    added = store.spark.read.schema(DOCS).parquet(f"{store.root}/{target}").count()
    if added:
        store.commit(state | {"docs": [*state["docs"], target], "next_doc_id": state["next_doc_id"] + added, "inserted_since_dedup": state["inserted_since_dedup"] + added}, version)
    told = marked.select("identity_hex", F.col("keeper._row").alias("_first"), "status")
    own = F.when(F.col("_row") == F.col("_first"), F.col("status")).otherwise("already_exists")
    return batch.select("identity_hex", "external_id", "_row").join(told, "identity_hex").select("identity_hex", "external_id", own.alias("status"))


def insert(store: Store, contents: DataFrame) -> DataFrame:
    """Ingests contents (external_id, content); see insert_rows."""
    policy = store.policy()
    return insert_rows(store, feature_rows(contents, policy))


def delete(store: Store, identities: DataFrame) -> DataFrame:
    """Deletes documents by identity_hex, in all trees. Returns identity_hex and status: deleted or missing. Content goes with compaction."""
    state, version = store.state()
    asked = identities.select(F.lower("identity_hex").alias("identity_hex")).distinct()
    hits = store.docs(state).join(asked, "identity_hex", "left_semi").select("identity_hex", "tree", "doc_id", F.current_timestamp().alias("deleted_at"))
    folder = store.new_folder("tombstones")
    hits.write.parquet(f"{store.root}/{folder}")
    gone = store.spark.read.parquet(f"{store.root}/{folder}")
    if not gone.isEmpty():
        store.commit(state | {"tombstones": [*state["tombstones"], folder]}, version)
    found = gone.select("identity_hex").distinct().withColumn("_hit", F.lit(True))
    return asked.join(found, "identity_hex", "left").select("identity_hex", F.when(F.col("_hit"), "deleted").otherwise("missing").alias("status"))


def duplicate_victims(docs: DataFrame) -> DataFrame:
    """All rows of an identity but the oldest, by tree, shard and number."""
    rank = F.row_number().over(Window.partitionBy("identity_hex").orderBy(*PLACE))
    return docs.select("identity_hex", *PLACE).withColumn("_n", rank).filter("_n > 1").drop("_n")


def dedup(store: Store, force: bool = False) -> dict:
    """Deletes all but the oldest document of each identity, once enough documents have come since the last time."""
    state, version = store.state()
    if not force and state["inserted_since_dedup"] < store.policy().dedup_min_docs:
        return {"due": False, "groups": 0, "deleted": 0}
    folder = store.new_folder("tombstones")
    duplicate_victims(store.docs(state)).select("identity_hex", "tree", "doc_id", F.current_timestamp().alias("deleted_at")).write.parquet(f"{store.root}/{folder}")
    groups, deleted = store.spark.read.parquet(f"{store.root}/{folder}").agg(F.count_distinct("identity_hex"), F.count("*")).first()
    own = [folder] if deleted else []
    store.commit(state | {"tombstones": [*state["tombstones"], *own], "inserted_since_dedup": 0}, version)
    return {"due": True, "groups": groups, "deleted": deleted}


def compact(store: Store, force: bool = False) -> dict:
    """Rewrites the live rows into a new generation and makes it current, if nothing has changed meanwhile.

    Before the cooldown since the last change has passed it does nothing. Old folders stay for readers; see collect_garbage.
    """
    state, version = store.state()
    if not state["tombstones"] and len(state["docs"]) <= 1 and not force:
        return {"compacted": False, "rows": None}
    if not force and time.time() - state["changed_at"] < store.policy().compaction_cooldown_s:
        return {"compacted": False, "rows": None}
    folder = store.new_folder("docs")
    _columns(store.docs(state)).repartition("tree", "shard").write.partitionBy("tree", "shard").parquet(f"{store.root}/{folder}")
    store.commit(state | {"docs": [folder], "tombstones": []}, version)
    return {"compacted": True, "rows": store.spark.read.schema(DOCS).parquet(f"{store.root}/{folder}").count()}


def merge_folders(store: Store, most: int | None = None) -> int:
    """Rewrites folders as one, once there are more than `most` (the policy's max_folders); how many were merged.

    The newest folders are merged as long as together they don't outgrow the next older one, so a row is rewritten a number of times that
    grows with the logarithm of the table, and the number of folders stays bounded. Deleted rows go on, as tombstones name them.
    """
    state, version = store.state()
    folders = state["docs"]
    if len(folders) <= (store.policy().max_folders if most is None else most):
        return 0
    size = {f: store.fs.getContentSummary(store.path(f"{store.root}/{f}")).getLength() for f in folders}
    first, total = len(folders) - 2, size[folders[-1]] + size[folders[-2]]
    while first > 0 and (size[folders[first - 1]] <= total or first > len(folders) // 2):
        first -= 1
        total += size[folders[first]]
    folder = store.new_folder("docs")
    rows = store.all_docs(state | {"docs": folders[first:]})
    _columns(rows).repartition("tree", "shard").write.partitionBy("tree", "shard").parquet(f"{store.root}/{folder}")
    store.commit(state | {"docs": [*folders[:first], folder]}, version)
    return len(folders) - first


def collect_garbage(store: Store) -> int:
    """Removes folders and states that the current state does not name. Readers of older states must be done."""
    state, version = store.state()
    keep, removed = {*state["docs"], *state["tombstones"]}, 0
    for kind in ("docs", "tombstones", "incoming"):
        top = store.path(f"{store.root}/{kind}")
        for s in store.fs.listStatus(top) if store.fs.exists(top) else []:
            if f"{kind}/{s.getPath().getName()}" not in keep:
                removed += store.fs.delete(s.getPath(), True)
    for s in store.fs.listStatus(store.path(store.root)):
        name = s.getPath().getName()
        if name.startswith("state-") and int(name[6:-5]) < version:
            store.fs.delete(s.getPath(), False)
    return removed


def stats(store: Store) -> DataFrame:
    """One row: live and deleted documents, sizes, filters' bytes, trees, shards, special documents."""
    state, _ = store.state()
    live = store.docs(state).agg(
        F.count("*").alias("live_docs"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.count_if("special_population").alias("special_docs"),
        F.coalesce(F.sum(F.size("t1_words") * 8), F.lit(0)).alias("tier1_bytes"), F.coalesce(F.sum(F.size("t2_words") * 8), F.lit(0)).alias("tier2_bytes"),
        F.count_distinct("tree").alias("trees"), F.count_distinct("tree", "shard").alias("shards"),
    )
    gone = store.tombstones(state).select("tree", "doc_id").distinct().count()
    return live.withColumn("deleted_docs", F.lit(gone).cast("long"))


def source_reference(docs: DataFrame) -> DataFrame:
    """identity_hex with its place, sorted by both over all partitions."""
    return docs.select("identity_hex", *PLACE).repartitionByRange("identity_hex", *PLACE).sortWithinPartitions("identity_hex", *PLACE)


def export_live(store: Store, path: str) -> None:
    _columns(store.docs()).write.parquet(path)


def import_rows(store: Store, path: str) -> DataFrame:
    """Inserts exported rows, which keep their features; see insert_rows."""
    return insert_rows(store, store.spark.read.schema(DOCS).parquet(path).drop("doc_id", "tree", "shard"))


def lookup(docs: DataFrame, identities: DataFrame) -> DataFrame:
    """identities (order, identity_hex) with external_id and doc_id, null where there is none, in order."""
    own = docs.groupBy("identity_hex").agg(F.min(F.struct("tree", "doc_id", "external_id")).alias("f"))
    return identities.join(own, "identity_hex", "left").select("order", "identity_hex", "f.external_id", "f.doc_id").orderBy("order")
