"""Conditions as exact predicates over contents. They depend on no index."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytesift.functions import automaton
from bytesift.functions.content import binary, bounded_batches, digest, entropy_of, headers_of, latin1
from bytesift.functions.fields import BOOLEANS, column_name
from bytesift.plans.ast import And, At, Const, Contains, Count, Entropy, Field, FieldField, FieldNow, FileSize, Identity, Ignored, In, Node, NOf, Not, Now, Offset, Or, Read, Verified, walk
from bytesift.plans.errors import RuleError
from bytesift.plans.patterns import Pattern

ANY = r"[\x00-\xff]"


def compare(left: Column, op: str, right) -> Column:
    return {"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


@dataclass
class Content:
    """Where a predicate finds a row's content, and the columns of what Python computes from it; see prepared."""

    content: Column
    size: Column | None = None
    meta: Column | None = None
    entropy: Column | None = None
    now: int = field(default_factory=lambda: int(time.time()))

    def __post_init__(self):
        self.text = latin1(self.content)
        self.size = F.octet_length(self.content).cast("long") if self.size is None else self.size

    def field(self, name: str) -> Column:
        if self.meta is None:
            raise ValueError("the condition needs header fields")
        return self.meta[column_name(name) if "." in name else name]


def prepared(df: DataFrame, conditions: list[Node], content: str, now: int | None = None) -> tuple[DataFrame, Content, list[str]]:
    """df with the columns that need Python, if a condition needs them, where predicates find them, and these columns' names.

    They are marked as not deterministic, so that each is computed once a row and not once a use. Every expression that Python reads has a
    column of contents of its own, so batches are bounded by bytes.
    """
    bounded_batches(df.sparkSession)
    nodes = [n for c in conditions for n in walk(c)]
    meta = any(isinstance(n, (Field, FieldNow, FieldField)) or isinstance(n, (At, In)) and "pe.entry_point" in {n.offset.base if isinstance(n, At) else n.low.base} for n in nodes)
    extra = []
    if meta:
        df, extra = df.withColumn("_meta", headers_of(F.col(content))), [*extra, "_meta"]
    if any(isinstance(n, Entropy) for n in nodes):
        df, extra = df.withColumn("_entropy", entropy_of(F.col(content))), [*extra, "_entropy"]
    own = {c.lstrip("_"): F.col(c) for c in extra}
    return df, Content(F.col(content), now=int(time.time()) if now is None else now, **own), extra


def _with_anchor(p: Pattern, c: Content) -> Column:
    """The content where it has one of the pattern's anchors, else null: most contents need no Python."""
    own = p.anchors(2)
    return F.when(reduce(or_, (F.contains(c.content, binary(t)) for t in sorted(own))), c.content) if own else c.content


def occurs(p: Pattern, c: Content) -> Column:
    if p.texts:
        return reduce(or_, (F.contains(c.content, binary(t)) for t in p.texts))
    if p.forms:
        return automaton.any_start(p.forms, _with_anchor(p, c), F.lit(0).cast("long"), c.size)
    return c.text.rlike(p.regex)


def _until_end(offset: Offset, least: bool) -> str:
    """The start is at least (or at most) offset bytes from the size on: so many bytes are left at most (or at least)."""
    left = -offset.value
    if least:
        return rf"(?={ANY}{{0,{left}}}\z)" if left >= 0 else "(?!)"
    return f"(?={ANY}{{{left}}})" if left > 0 else ""


def starts_between(p: Pattern, low: Offset, high: Offset, c: Content) -> Column:
    """A match starts in low..high, both included."""
    if p.forms:
        place = lambda o: F.lit(o.value).cast("long") + {None: F.lit(0).cast("long"), "filesize": c.size}[o.base]
        return automaton.any_start(p.forms, _with_anchor(p, c), place(low), place(high))
    if low.base is None and high.base is None:
        if high.value < max(0, low.value):
            return F.lit(False)
        before = f"{ANY}{{{max(0, low.value)},{high.value}}}?"
        return c.text.rlike(rf"\A{before}(?:{p.regex})")
    before = f"{ANY}{{{max(0, low.value)},}}?" if low.base is None else f"{ANY}*?" if high.base else f"{ANY}{{0,{high.value}}}?" if high.value >= 0 else "(?!)"
    ahead = (_until_end(low, True) if low.base else "") + (_until_end(high, False) if high.base else "")
    return c.text.rlike(rf"\A{before}{ahead}(?:{p.regex})")


def starts_at(p: Pattern, at: Offset, c: Content) -> Column:
    if at.base == "filesize":
        return starts_between(p, at, at, c)
    if at.base is None:
        if at.value < 0:
            return F.lit(False)
        if p.texts:
            return reduce(or_, (F.substring(c.content, at.value + 1, len(t)) == binary(t) for t in p.texts))
        if p.forms:
            return starts_between(p, at, at, c)
        return c.text.rlike(rf"\A{ANY}{{{at.value}}}(?:{p.regex})")
    place = c.field("pe_entry_point") + at.value
    start = (place + 1).cast("int")
    if p.texts:
        own = reduce(or_, (F.substring(c.content, start, F.lit(len(t))) == binary(t) for t in p.texts))
    elif p.forms:
        own = automaton.any_start(p.forms, _with_anchor(p, c), place.cast("long"), place.cast("long"))
    else:
        own = F.substring(c.text, start, F.length(c.text)).rlike(rf"\A(?:{p.regex})")
    return F.coalesce((place >= 0) & own, F.lit(False))


def occurrences(p: Pattern, c: Content) -> Column:
    """The number of offsets at which a match starts; matches may overlap."""
    if p.forms:
        return automaton.count_starts(p.forms, _with_anchor(p, c))
    return F.regexp_count(c.text, F.lit(f"(?={p.regex})"))


def field_compare(name: str, op: str, value, c: Content) -> Column:
    """Any value of a field compares so. A field that a content does not have compares with nothing."""
    own = c.field(name)
    if name in BOOLEANS:
        return F.coalesce(compare(own, op, F.lit(bool(value))), F.lit(False))
    return F.coalesce(F.exists(own, lambda v: compare(v, op, F.lit(value))), F.lit(False))


def predicate(node: Node, patterns: dict[str, Pattern], c: Content) -> Column:
    """Whether a content matches a condition: true or false for every content that is not null.

    Predicates of unknown modules can't be evaluated; they raise `ignored-module`.
    """
    go = lambda n: predicate(n, patterns, c)
    if isinstance(node, Const):
        return F.lit(node.value)
    if isinstance(node, Contains):
        return occurs(patterns[node.string], c)
    if isinstance(node, At):
        return starts_at(patterns[node.string], node.offset, c)
    if isinstance(node, In):
        return starts_between(patterns[node.string], node.low, node.high, c)
    if isinstance(node, Count):
        return compare(occurrences(patterns[node.string], c), node.op, node.value)
    if isinstance(node, Verified):
        return go(node.exact)
    if isinstance(node, And):
        return reduce(and_, map(go, node.items))
    if isinstance(node, Or):
        return reduce(or_, map(go, node.items))
    if isinstance(node, Not):
        return ~go(node.item)
    if isinstance(node, NOf):
        if node.least > len(node.items):
            return F.lit(False)  # the optimizer drops the scan
        if node.least == 1:
            return reduce(or_, map(go, node.items))
        if node.least == len(node.items):
            return reduce(and_, map(go, node.items))
        return reduce(add, (go(i).cast("int") for i in node.items)) >= node.least
    if isinstance(node, FileSize):
        return compare(c.size, node.op, F.lit(node.value))
    if isinstance(node, Field):
        return field_compare(node.name, node.op, node.value, c)
    if isinstance(node, FieldNow):
        return field_compare(node.name, node.op, c.now, c)
    if isinstance(node, FieldField):
        return F.coalesce(F.exists(c.field(node.left), lambda a: F.exists(c.field(node.right), lambda b: compare(a, node.op, b))), F.lit(False))
    if isinstance(node, Now):
        return compare(F.lit(c.now), node.op, F.lit(node.value))
    if isinstance(node, Entropy):
        if c.entropy is None:
            raise ValueError("the condition needs the entropy")
        return compare(c.entropy.cast("float"), node.op, F.lit(node.value).cast("float"))
    if isinstance(node, Identity):
        return digest(c.content, node.kind) == node.digest
    if isinstance(node, Read):
        return F.substring(c.content, node.offset + 1, len(node.data)) == binary(node.data)
    if isinstance(node, Ignored):
        raise RuleError("ignored-module", f"{node.call} can't be evaluated")
    raise TypeError(node)
