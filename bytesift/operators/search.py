"""Searches: candidates from the index, exact verification, bundles, caps, pages, profiles."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytesift.operators import exact, index
from bytesift.plans.policy import Policy
from bytesift.plans.resolve import Query, compile_source

ALL_TIERS = frozenset([1, 2])
#: Hexadecimal digits of identities by which hits are counted before they are cut off.
CAP_DIGITS = 4


@dataclass(frozen=True)
class Options:
    """cap_percent: candidates of a rule, as a share of live documents (0: all). tiers: the filters that are tested."""

    cap_percent: float = 10.0
    max_anchors: int = 16
    tiers: frozenset[int] = ALL_TIERS
    now: int | None = None

    def at(self) -> int:
        return int(time.time()) if self.now is None else self.now


def cap(live: int, percent: float) -> int | None:
    """The number of candidates that a share of live documents allows: rounded up, one at least; None: no bound."""
    if not math.isfinite(percent) or percent <= 0:
        return None
    return max(1, math.ceil(live * percent / 100))


def may_match(query: Query, policy: Policy, options: Options) -> Column:
    """Whether a row of the index may match; true where only the content can tell."""
    own = index.predicate(query.condition, query.patterns, index.Index(policy, options.tiers, options.max_anchors, options.at()))
    return F.coalesce(own, F.lit(True))


def matches(query: Query, content: exact.Content) -> Column:
    return F.coalesce(exact.predicate(query.condition, query.patterns, content), F.lit(False))


def seeded(docs: DataFrame, query: Query, policy: Policy) -> DataFrame:
    """docs without the rows that the condition's digests rule out; a lookup by identity that reaches the scan's statistics."""
    seeds = index.identity_seeds(query.condition, policy.id_source)
    return docs if seeds is None else docs.filter(F.col("identity_hex").isin(sorted(seeds)) if seeds else F.lit(False))


def _tagged(df: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    """df with a row for each rule whose test holds: one scan for all rules."""
    if len(tests) == 1:
        return df.filter(tests[0][1]).withColumn("rule", F.lit(tests[0][0]))
    hit = reduce(or_, (t for _, t in tests)) if len(tests) <= 8 else None
    df = df.filter(hit) if hit is not None else df
    names = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))
    return df.withColumn("rule", F.explode(names))


def candidates(docs: DataFrame, queries: list[Query], policy: Policy, options: Options = Options()) -> DataFrame:
    """rule, identity_hex, external_id, tree, doc_id: documents that may match, each once a rule. Holds every match."""
    base = seeded(docs, queries[0], policy) if len(queries) == 1 else docs
    tagged = _tagged(base, [(q.name, may_match(q, policy, options)) for q in queries])
    return tagged.select("rule", "identity_hex", "external_id", "tree", "doc_id")


def distinct_hits(found: DataFrame) -> DataFrame:
    """Hits of several tables or trees as one: each identity once a rule, with its first place."""
    first = F.min(F.struct("tree", "doc_id", "external_id"))
    return found.groupBy("rule", "identity_hex").agg(first.alias("f")).select("rule", "identity_hex", "f.external_id", "f.tree", "f.doc_id")


def capped(found: DataFrame, live: int, percent: float) -> tuple[DataFrame, DataFrame]:
    """The hits within the cap, by identity, and rule, candidates, truncated, truncated_limit of each rule with hits."""
    limit = cap(live, percent)
    counts = found.groupBy("rule").agg(F.count("*").alias("n"))
    if limit is None:
        return found, counts.select("rule", F.col("n").alias("candidates"), F.lit(False).alias("truncated"), F.lit(None).cast("long").alias("truncated_limit"))
    over = F.col("n") > limit
    summary = counts.select("rule", F.least("n", F.lit(limit)).alias("candidates"), over.alias("truncated"), F.when(over, F.lit(limit)).cast("long").alias("truncated_limit"))
    # Rows are counted by the first digits of their identity; only those where the cap falls are ranked.
    digits = F.substring("identity_hex", 1, CAP_DIGITS)
    before = F.sum("c").over(Window.partitionBy("rule").orderBy("at")) - F.col("c")
    ranges = found.groupBy("rule", digits.alias("at")).agg(F.count("*").alias("c")).withColumn("before", before)
    edge = ranges.filter((F.col("before") <= limit) & (F.col("before") + F.col("c") > limit)).select("rule", F.col("at").alias("_at"), (F.lit(limit) - F.col("before")).alias("_room"))
    cut = found.join(F.broadcast(edge), "rule", "left")  # one row a rule
    rank = F.row_number().over(Window.partitionBy("rule").orderBy("identity_hex", "tree", "doc_id"))
    within = cut.filter(F.col("_at").isNull() | (digits < F.col("_at")))
    last = cut.filter(digits == F.col("_at")).withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_room"))
    return within.select(*found.columns).unionByName(last.select(*found.columns)), summary


def page(found: DataFrame, cursor: int, size: int) -> DataFrame:
    return found.orderBy("rule", "identity_hex").offset(cursor).limit(size)


def verify(found: DataFrame, contents: DataFrame, queries: list[Query], key: str = "external_id", now: int | None = None) -> DataFrame:
    """found with state: matched, not_matched, or skipped if the content is gone. contents: key, content.

    Each candidate document is read once, whatever the number of rules that it is a candidate of.
    """
    docs = found.groupBy(key).agg(F.collect_set("rule").alias("rules"))
    read = docs.join(contents.select(key, "content"), key, "left")
    read, c, _ = exact.prepared(read, [q.condition for q in queries], "content", now)
    own = F.array(*[F.struct(F.lit(q.name).alias("rule"), F.when(F.array_contains("rules", q.name), matches(q, c)).alias("hit")) for q in queries])
    states = read.select(key, F.col("content").isNotNull().alias("there"), F.explode(own).alias("v")).filter(F.col("v.hit").isNotNull() | ~F.col("there"))
    states = states.select(key, F.col("v.rule").alias("rule"), F.when(~F.col("there"), "skipped").when(F.col("v.hit"), "matched").otherwise("not_matched").alias("state"))
    return found.join(states, [key, "rule"], "left").withColumn("state", F.coalesce("state", F.lit("skipped")))


def verified_counts(verified: DataFrame) -> DataFrame:
    """rule, checked, matched, skipped."""
    s = F.col("state")
    return verified.groupBy("rule").agg(F.count_if(s != "skipped").alias("checked"), F.count_if(s == "matched").alias("matched"), F.count_if(s == "skipped").alias("skipped"))


def display_order(verified: DataFrame) -> DataFrame:
    """Matched rows first, then skipped ones; the others are not shown."""
    rank = F.when(F.col("state") == "matched", 0).otherwise(1)
    return verified.filter("state <> 'not_matched'").orderBy("rule", rank, "identity_hex")


def scan(contents: DataFrame, queries: list[Query] | str, now: int | None = None, content_col: str = "content") -> DataFrame:
    """contents with rule, a row for each rule that a content matches exactly: one scan, no index."""
    queries = compile_source(queries) if isinstance(queries, str) else queries
    df, c, extra = exact.prepared(contents, [q.condition for q in queries], content_col, now)
    return _tagged(df, [(q.name, matches(q, c)) for q in queries]).drop(*extra)


def truth(contents: DataFrame, queries: list[Query], key: str = "external_id") -> DataFrame:
    """rule and the sorted keys of its exact matches, as a check of recall."""
    hits = scan(contents, queries).groupBy("rule").agg(F.array_sort(F.collect_list(key)).alias("matches"))
    return hits


def join_truth(true_hits: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rule, matches, candidates, missed (true but not found), precision and recall of a candidate set."""
    t = true_hits.select("rule", *keys).distinct().withColumn("t", F.lit(1))
    f = found.select("rule", *keys).distinct().withColumn("f", F.lit(1))
    both = t.join(f, ["rule", *keys], "full_outer")
    out = both.groupBy("rule").agg(F.count("t").alias("matches"), F.count("f").alias("candidates"), F.count_if(F.col("t").isNotNull() & F.col("f").isNull()).alias("missed"))
    good = F.col("matches") - F.col("missed")
    return out.withColumn("precision", F.when(F.col("candidates") > 0, good / F.col("candidates"))).withColumn("recall", F.when(F.col("matches") > 0, good / F.col("matches")))


def profiled(docs: DataFrame, name: str = "profile"):
    """docs with an observation of what a search reads: rows, tier-1 and tier-2 bytes."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return docs.observe(seen, F.count(F.lit(1)).alias("docs_scanned"), F.sum(F.size("t1_words") * 8).alias("tier1_bytes"), F.sum(F.size("t2_words") * 8).alias("tier2_bytes")), seen


def impossible(query: Query) -> bool:
    """Whether no document can match: `N of` with fewer than N strings, alone or under `and`."""
    from bytesift.plans.ast import And, Const, NOf, Or

    def no(n) -> bool:
        if isinstance(n, Const):
            return not n.value
        if isinstance(n, NOf):
            return n.least > sum(not no(i) for i in n.items)
        if isinstance(n, And):
            return any(map(no, n.items))
        return isinstance(n, Or) and all(map(no, n.items))

    return no(query.condition)


__all__ = ["candidates", "cap", "capped", "display_order", "distinct_hits", "impossible", "join_truth", "matches", "may_match", "page", "profiled", "scan", "seeded", "truth", "verified_counts", "verify"]
