"""The engine's table: Parquet generations, tombstones, a policy, and a pointer that makes changes visible at once.

Nothing that a reader may have open is changed. A commit writes a new pointer file that names the folders of
documents and tombstones; pointers are numbered, the highest one counts, and it is put in place by a rename. On file
systems whose rename is not atomic (object stores), two writers may both believe they have committed: have one writer there.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesift.functions.headers import META_DDL
from bytesift.plans.policy import Policy

DOCS = (
    "identity_hex string, file_size long, external_id string, special_population boolean, "
    "t1_words array<long>, t1_log2 int, t2_words array<long>, t2_log2 int, prefix8 binary, entropy float, "
    f"meta struct<{', '.join(p.replace(' ', ':', 1) for p in META_DDL.split(', '))}>, doc_id long, tree int, shard int"
)
TOMBSTONES = "identity_hex string, tree int, doc_id long, deleted_at timestamp"


class ConcurrentChange(RuntimeError):
    """Another writer has committed since the state was read."""


class Store:
    """A table below a root that Spark's file systems can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # small files through Hadoop's file systems

    def _write(self, name: str, text: str, only_new: bool) -> bool:
        """A whole file or nothing: written beside and renamed. only_new: False if there is one already."""
        target, part = self.path(f"{self.root}/{name}"), self.path(f"{self.root}/.{uuid.uuid4().hex}")
        out = self.fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not only_new:
            self.fs.delete(target, False)
        done = not self.fs.exists(target) and self.fs.rename(part, target)
        if not done:
            self.fs.delete(part, False)
        return done

    def _read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def is_file(self, path: str) -> bool:
        """Whether a path, with or without a file system's name, is a file; without one it is local."""
        try:
            own = self.path(path if "://" in path or path.startswith("file:") else f"file:{os.path.abspath(path)}")
            fs = own.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
            return fs.exists(own) and fs.getFileStatus(own).isFile()
        except Exception:  # no path at all, or of no known file system
            return False

    def exists(self) -> bool:
        return self.fs.exists(self.path(f"{self.root}/policy.json"))

    def init(self, policy: Policy, force: bool = False) -> None:
        if self.exists() and not force:
            raise FileExistsError(f"{self.root} has a table already")
        if force:
            self.fs.delete(self.path(self.root), True)
        self.fs.mkdirs(self.path(self.root))
        self._write("policy.json", policy.to_json(), only_new=True)
        self.commit({"docs": [], "tombstones": [], "next_doc_id": 0, "inserted_since_dedup": 0, "changed_at": 0.0}, -1)

    def policy(self) -> Policy:
        return Policy.from_json(self._read("policy.json"))

    def state(self) -> tuple[dict, int]:
        """The newest state and its number."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.root))]
        version = max(int(n[6:-5]) for n in names if n.startswith("state-") and n.endswith(".json"))
        return json.loads(self._read(f"state-{version}.json")), version

    def commit(self, state: dict, read_version: int) -> int:
        """Makes a state current if nobody else has committed since read_version."""
        if not self._write(f"state-{read_version + 1}.json", json.dumps(state | {"changed_at": time.time()}), only_new=True):
            raise ConcurrentChange("another writer has committed; read again")
        return read_version + 1

    # tables

    def new_folder(self, kind: str) -> str:
        return f"{kind}/gen=g{time.time_ns()}-{uuid.uuid4().hex[:8]}"

    def _load(self, kind: str, folders: list[str], schema: str) -> DataFrame:
        """All folders of a kind in one scan, whatever their number."""
        empty = self.spark.createDataFrame([], schema)
        if not folders:
            return empty
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*[f"{self.root}/{f}" for f in folders]).select(*empty.columns)

    def all_docs(self, state: dict | None = None) -> DataFrame:
        """Every stored row, deleted ones too."""
        return self._load("docs", (state or self.state()[0])["docs"], DOCS)

    def tombstones(self, state: dict | None = None) -> DataFrame:
        return self._load("tombstones", (state or self.state()[0])["tombstones"], TOMBSTONES)

    def docs(self, state: dict | None = None) -> DataFrame:
        """The live rows."""
        state = state or self.state()[0]
        rows = self.all_docs(state)
        if not state["tombstones"]:
            return rows
        return rows.join(self.tombstones(state).select("tree", "doc_id"), ["tree", "doc_id"], "left_anti")
