"""Conditions as three-valued predicates over the index: true, false, or null for `only the content can tell`.

A filter that lacks a gram proves a string's absence; one that has all its grams proves nothing. Null is widened to true
once, at the root, so a candidate set holds every match.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from bytesift.functions.bloom import literal_grams, may_hold
from bytesift.functions.content import binary
from bytesift.functions.fields import BOOLEANS, column_name
from bytesift.operators.exact import compare
from bytesift.plans.ast import And, At, Const, Contains, Count, Entropy, Field, FieldField, FieldNow, FileSize, Identity, Ignored, In, Node, NOf, Not, Now, Or, Read, Verified, walk
from bytesift.plans.patterns import Pattern
from bytesift.plans.policy import Policy


def unknown() -> Column:
    return F.lit(None).cast("boolean")


@dataclass
class Index:
    """How an index's columns are read. tiers: which filters are tested (1, 2)."""

    policy: Policy
    tiers: frozenset[int] = frozenset([1, 2])
    max_anchors: int = 16
    now: int = field(default_factory=lambda: int(time.time()))

    def tier(self, t: int) -> tuple[Column, Column, int, int]:
        return F.col(f"t{t}_words"), F.col(f"t{t}_log2"), self.policy.grams[t - 1], self.policy.bits(t)


def anchor_grams(p: Pattern, index: Index) -> list[dict[int, list[int]]] | None:
    """The grams of each alternative by tier; None if the pattern has no anchor, so that the index can't tell."""
    least = index.policy.grams[0]
    own = p.anchors(least)
    if own is None:
        return None
    most = max(2, index.max_anchors // (1 if len(own) <= 8 else 4))
    out = []
    for data in sorted(own):
        grams = {t: literal_grams(data, index.policy.grams[t - 1], most) for t in sorted(index.tiers)}
        if not any(grams.values()):
            return None
        out.append({t: g for t, g in grams.items() if g})
    return out


def may_contain(p: Pattern, index: Index) -> Column:
    """False where a filter proves that no alternative occurs, else null. Tier-1 tests come before tier-2 tests."""
    alternatives = anchor_grams(p, index)
    if alternatives is None:
        return unknown()
    tests = []
    for grams in alternatives:
        hits = [may_hold(*index.tier(t)[:2], g, index.tier(t)[3]) for t in sorted(grams) for g in grams[t]]
        tests.append(reduce(and_, hits))
    return F.when(reduce(or_, tests), unknown()).otherwise(F.lit(False))


def _prefix_at(p: Pattern, prefix: Column, width: int, known: Column, rest: Column) -> Column:
    """A fixed string against the stored first bytes: decided if it fits, refuted if its beginning differs."""
    if not p.texts:
        return rest
    starts = reduce(or_, (F.substring(prefix, 1, min(len(t), width)) == binary(t[:width]) for t in p.texts))
    fits = all(len(t) <= width for t in p.texts)
    return F.when(known & starts, F.lit(True) if fits else rest).when(known, F.lit(False)).otherwise(rest)


def predicate(node: Node, patterns: dict[str, Pattern], index: Index) -> Column:
    go = lambda n: predicate(n, patterns, index)
    if isinstance(node, Const):
        return F.lit(node.value)
    if isinstance(node, Contains):
        return may_contain(patterns[node.string], index)
    if isinstance(node, At):
        p = patterns[node.string]
        rest = may_contain(p, index)
        if node.offset.base is None and node.offset.value == 0:
            return _prefix_at(p, F.col("prefix8"), 8, F.col("prefix8").isNotNull(), rest)
        if node.offset.base == "pe.entry_point" and node.offset.value == 0:
            meta = F.col("meta")
            decided = _prefix_at(p, meta["pe_entry_bytes"], 16, meta["pe_entry_bytes"].isNotNull(), rest)
            return F.when(meta.isNull(), rest).when(meta["pe_entry_point"].isNull(), F.lit(False)).otherwise(decided)
        return rest
    if isinstance(node, In):
        return may_contain(patterns[node.string], index)
    if isinstance(node, Count):
        # `fewer than N` holds for a content without the string as well.
        return unknown() if node.op in ("<", "<=") or node.op == "==" and node.value == 0 else may_contain(patterns[node.string], index)
    if isinstance(node, Verified):
        return go(node.needs)
    if isinstance(node, And):
        return reduce(and_, map(go, node.items))
    if isinstance(node, Or):
        # What the row itself decides comes before what costs filter tests.
        return reduce(or_, map(go, sorted(node.items, key=lambda n: any(isinstance(x, (Contains, At, In, Count)) for x in walk(n)))))
    if isinstance(node, Not):
        return ~go(node.item)
    if isinstance(node, NOf):
        if node.least > len(node.items):
            return F.lit(False)
        own = [go(i) for i in node.items]
        possible = reduce(add, (F.coalesce(x, F.lit(True)).cast("int") for x in own)) >= node.least
        certain = reduce(add, (F.coalesce(x, F.lit(False)).cast("int") for x in own)) >= node.least
        return F.when(certain, F.lit(True)).when(~possible, F.lit(False)).otherwise(unknown())
    if isinstance(node, FileSize):
        return compare(F.col("file_size"), node.op, F.lit(node.value))
    if isinstance(node, (Field, FieldNow)):
        own, value = F.col("meta")[column_name(node.name)], node.value if isinstance(node, Field) else index.now
        test = compare(own, node.op, F.lit(bool(value))) if node.name in BOOLEANS else F.exists(own, lambda v: compare(v, node.op, F.lit(value)))
        return F.when(F.col("meta").isNotNull(), F.coalesce(test, F.lit(False)))
    if isinstance(node, FieldField):
        a, b = (F.col("meta")[column_name(n)] for n in (node.left, node.right))
        return F.when(F.col("meta").isNotNull(), F.coalesce(F.exists(a, lambda x: F.exists(b, lambda y: compare(x, node.op, y))), F.lit(False)))
    if isinstance(node, Now):
        return compare(F.lit(index.now), node.op, F.lit(node.value))
    if isinstance(node, Entropy):
        return compare(F.col("entropy"), node.op, F.lit(node.value).cast("float"))
    if isinstance(node, Identity):
        return F.col("identity_hex") == node.digest if node.kind == index.policy.id_source else unknown()
    if isinstance(node, Read):
        if node.offset + len(node.data) <= 8:
            return F.substring("prefix8", node.offset + 1, len(node.data)) == binary(node.data)
        n = index.policy.grams[0]
        if len(node.data) >= n:  # the bytes occur somewhere at least
            hits = [may_hold(*index.tier(t)[:2], g, index.tier(t)[3]) for t in sorted(index.tiers) for g in literal_grams(node.data, index.policy.grams[t - 1], 16)]
            return F.when(reduce(and_, hits), unknown()).otherwise(F.lit(False)) if hits else unknown()
        return unknown()
    if isinstance(node, Ignored):
        return unknown()
    raise TypeError(node)


def tiers_used(node: Node, patterns: dict[str, Pattern], index: Index) -> str:
    """Which tiers a plan tests: none, tier1, tier2 or tier1+tier2."""
    used: set[int] = set()
    for n in walk(node):
        n = n.needs if isinstance(n, Verified) else n
        if isinstance(n, (Contains, At, In, Count)):
            for grams in anchor_grams(patterns[n.string], index) or []:
                used |= grams.keys()
    return "+".join(f"tier{t}" for t in sorted(used)) or "none"


def identity_seeds(node: Node, kind: str) -> frozenset[str] | None:
    """The digests to which a condition restricts the identity: intersected by `and`, united by `or`; None if it does not."""
    if isinstance(node, Identity) and node.kind == kind:
        return frozenset([node.digest])
    if isinstance(node, And):
        own = [s for s in (identity_seeds(i, kind) for i in node.items) if s is not None]
        return frozenset.intersection(*own) if own else None
    if isinstance(node, Or):
        own = [identity_seeds(i, kind) for i in node.items]
        return frozenset().union(*own) if None not in own else None
    return None
