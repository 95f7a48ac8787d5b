"""The engine: a table of documents and what can be asked of it."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesift.functions.content import digest
from bytesift.functions.fields import DIGESTS
from bytesift.operators import maintenance, search
from bytesift.operators.index import Index, tiers_used
from bytesift.plans.check import FileReport, check_source
from bytesift.plans.parser import expand_includes
from bytesift.plans.policy import Policy
from bytesift.plans.resolve import Query, compile_source
from bytesift.sources.files import scan_files, text_contents
from bytesift.sources.store import Store


def load_rules(path: str) -> str:
    """A rule file's text with its includes."""

    def read(p: str) -> str:
        with open(p, encoding="utf-8") as f:
            return f.read()

    return expand_includes(path, read)


@dataclass
class Result:
    """hits: rule, identity_hex, external_id, tree, doc_id - and state if verified. summary: a row a rule."""

    hits: DataFrame
    summary: DataFrame
    tiers: dict[str, str]


class Engine:
    """A table below root, or several tables searched as one."""

    def __init__(self, spark: SparkSession, root: str | list[str]):
        self.spark = spark
        self.stores = [Store(spark, r) for r in ([root] if isinstance(root, str) else root)]

    @property
    def store(self) -> Store:
        return self.stores[0]

    def init(self, policy: Policy | None = None, force: bool = False) -> Engine:
        for s in self.stores:
            s.init(policy or Policy(), force)
        return self

    def policy(self) -> Policy:
        """The tables' policy; tables that can't be searched as one are an error."""
        own = [s.policy() for s in self.stores]
        if not all(own[0].searches_with(p) for p in own):
            raise ValueError("the tables' policies differ in identity source, gram sizes or filter bits")
        return own[0]

    def contents(self, source) -> DataFrame:
        """Paths, or a frame with content and external_id, as contents."""
        if isinstance(source, DataFrame):
            return source
        return scan_files(self.spark, source).select(F.col("path").alias("external_id"), "content")

    def ingest(self, source, id_col: str | None = None, text_col: str = "text") -> DataFrame:
        """Inserts files or rows into the table with the fewest documents. Returns each one's status."""
        contents = text_contents(source, id_col, text_col) if id_col else self.contents(source)
        target = min(self.stores, key=lambda s: s.state()[0]["next_doc_id"]) if len(self.stores) > 1 else self.store
        return maintenance.insert(target, contents)

    def delete(self, values: list[str]) -> DataFrame:
        """Deletes by digest, or by the path of a file, from all tables: deleted if any table had it."""
        kind, hexes = self.policy().id_source, []
        for v in values:
            if self.store.is_file(v):  # on whatever file system the path names, read by an executor
                content = self.spark.read.format("binaryFile").load(v if "://" in v else f"file:{os.path.abspath(v)}")
                hexes.append(content.select(digest(F.col("content"), kind)).first()[0])
            elif len(v) == DIGESTS[kind] and all(c in "0123456789abcdefABCDEF" for c in v):
                hexes.append(v.lower())
            else:
                raise ValueError(f"{v} is neither a file nor a {kind} digest")
        asked = self.spark.createDataFrame([(h,) for h in hexes], "identity_hex string")
        each = [maintenance.delete(s, asked) for s in self.stores]
        out = each[0]
        for e in each[1:]:
            out = out.unionByName(e)
        return out.groupBy("identity_hex").agg(F.min("status").alias("status"))  # deleted < missing

    def check(self, source: str) -> FileReport:
        return check_source(source, self.policy())

    def live(self) -> DataFrame:
        out = self.stores[0].docs()
        for s in self.stores[1:]:
            out = out.unionByName(s.docs())
        return out

    def search(self, source: str | list[Query], options: search.Options | None = None, contents: DataFrame | None = None, force: bool = False) -> Result:
        """Candidates of each rule of a text, in one scan; verified exactly if contents (external_id, content) are given.

        A rule that the index can't answer is an error, unless force is set.
        """
        options = options or search.Options()
        policy = self.policy()
        if isinstance(source, str):
            if not force:
                bad = [r for r in self.check(source).rules if r.status == "unsupported" and not r.is_private]
                if bad:
                    issue = next(i for i in bad[0].issues if i.severity == "error")
                    raise ValueError(f"{bad[0].rule}: {issue.code}: {issue.message}")
            source = compile_source(source)
        if options.now is None:
            options = search.Options(options.cap_percent, options.max_anchors, options.tiers, int(time.time()))
        docs = self.live()
        found = search.distinct_hits(search.candidates(docs, source, policy, options))
        hits, summary = search.capped(found, docs.count(), options.cap_percent)
        index = Index(policy, options.tiers, options.max_anchors, options.now)
        if contents is not None:
            hits = search.verify(hits, contents, source, now=options.now)
        return Result(hits, summary, {q.name: tiers_used(q.condition, q.patterns, index) for q in source})

    def scan(self, source: str, paths, tag: str | None = None) -> DataFrame:
        """rule and external_id of each exact match among files, without an index; with a tag, of the rules that have it."""
        queries = compile_source(source, tag)
        if not queries:
            return self.spark.createDataFrame([], "rule string, external_id string")
        return search.scan(self.contents(paths), queries).select("rule", "external_id")

    def info(self) -> DataFrame:
        out = maintenance.stats(self.stores[0])
        for s in self.stores[1:]:
            out = out.unionByName(maintenance.stats(s))
        return out

    def compact(self, force: bool = False) -> list[dict]:
        return [maintenance.compact(s, force) for s in self.stores]

    def dedup(self, force: bool = False) -> list[dict]:
        return [maintenance.dedup(s, force) for s in self.stores]
