"""The syntax tree of rules. Conditions are trees of frozen nodes."""

from __future__ import annotations

from dataclasses import dataclass, field


class Node:
    """A condition."""

    def children(self) -> tuple[Node, ...]:
        return ()


@dataclass(frozen=True)
class Const(Node):
    value: bool


@dataclass(frozen=True)
class Contains(Node):
    """$a: the string occurs."""

    string: str


@dataclass(frozen=True)
class Offset:
    """A byte offset: a number, or a number from the file's size or from a field."""

    value: int
    base: str | None = None


@dataclass(frozen=True)
class At(Node):
    string: str
    offset: Offset


@dataclass(frozen=True)
class In(Node):
    """A match starts between two offsets, both included."""

    string: str
    low: Offset
    high: Offset


@dataclass(frozen=True)
class Count(Node):
    string: str
    op: str
    value: int


@dataclass(frozen=True)
class NOf(Node):
    least: int
    items: tuple[Node, ...]

    def children(self) -> tuple[Node, ...]:
        return self.items


@dataclass(frozen=True)
class And(Node):
    items: tuple[Node, ...]

    def children(self) -> tuple[Node, ...]:
        return self.items


@dataclass(frozen=True)
class Or(Node):
    items: tuple[Node, ...]

    def children(self) -> tuple[Node, ...]:
        return self.items


@dataclass(frozen=True)
class Not(Node):
    item: Node

    def children(self) -> tuple[Node, ...]:
        return (self.item,)


@dataclass(frozen=True)
class RuleRef(Node):
    name: str
    offset: int = field(default=0, compare=False)


@dataclass(frozen=True)
class FileSize(Node):
    op: str
    value: int


@dataclass(frozen=True)
class Field(Node):
    """A header field compared with a number or a truth value."""

    name: str
    op: str
    value: int | bool


@dataclass(frozen=True)
class FieldField(Node):
    left: str
    op: str
    right: str


@dataclass(frozen=True)
class FieldNow(Node):
    """A header field compared with the time of the query."""

    name: str
    op: str


@dataclass(frozen=True)
class Now(Node):
    op: str
    value: int


@dataclass(frozen=True)
class Entropy(Node):
    op: str
    value: float


@dataclass(frozen=True)
class Identity(Node):
    """The digest of the whole file."""

    kind: str
    digest: str


@dataclass(frozen=True)
class Read(Node):
    """A number read at a byte offset equals a literal, given as the bytes it is written in."""

    reader: str
    offset: int
    data: bytes


@dataclass(frozen=True)
class Ignored(Node):
    """A call of a module that neither the index nor the verifier knows."""

    call: str


@dataclass(frozen=True)
class Verified(Node):
    """What only verification decides: the exact condition and the string that it needs."""

    exact: Node
    needs: Node

    def children(self) -> tuple[Node, ...]:
        return (self.exact,)


@dataclass(frozen=True)
class StringDef:
    """A string of a rule: kind is text, regex or hex; value the bytes or the source between the delimiters."""

    name: str
    kind: str
    value: bytes | str
    modifiers: frozenset[str]
    offset: int


@dataclass(frozen=True)
class Rule:
    name: str
    private: bool
    is_global: bool
    tags: tuple[str, ...]
    meta: tuple[tuple[str, object], ...]
    strings: tuple[StringDef, ...]
    condition: Node
    offset: int
    ignored_calls: tuple[str, ...] = ()


def walk(node: Node):
    yield node
    for c in node.children():
        yield from walk(c)
