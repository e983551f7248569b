"""Query trees. Equality ignores where in the text a node came from."""

from __future__ import annotations

from dataclasses import dataclass, field

Span = tuple[int, int]
_at = lambda: field(default=(0, 0), compare=False, repr=False)


@dataclass(frozen=True)
class Term:
    token: str
    field: str | None = None
    span: Span = _at()


@dataclass(frozen=True)
class Wildcard:
    """stem* is any continuation, stem$ at most one more character."""

    stem: str
    op: str
    field: str | None = None
    span: Span = _at()


@dataclass(frozen=True)
class Phrase:
    items: tuple[Term | Wildcard, ...]
    field: str | None = None
    span: Span = _at()


@dataclass(frozen=True)
class Near:
    left: Term | Wildcard | Phrase
    right: Term | Wildcard | Phrase
    distance: int
    field: str | None = None
    span: Span = _at()


@dataclass(frozen=True, order=True)
class YearRange:
    lo: int
    hi: int


@dataclass(frozen=True)
class Filter:
    field: str
    values: tuple[str | YearRange, ...]
    span: Span = _at()


@dataclass(frozen=True)
class Not:
    child: Node
    span: Span = _at()


@dataclass(frozen=True)
class And:
    children: tuple[Node, ...]
    span: Span = _at()


@dataclass(frozen=True)
class Or:
    children: tuple[Node, ...]
    span: Span = _at()


Leaf = Term | Wildcard | Phrase | Near
Node = Leaf | Filter | Not | And | Or


def walk(n: Node):
    """The node and all below it, phrase items and proximity operands included."""
    yield n
    if isinstance(n, (And, Or)):
        for c in n.children:
            yield from walk(c)
    elif isinstance(n, Not):
        yield from walk(n.child)
    elif isinstance(n, Near):
        yield from walk(n.left)
        yield from walk(n.right)
    elif isinstance(n, Phrase):
        yield from n.items


def fold(n: Node, step):
    """step(node, results of its clauses), from the leaves up. A phrase or a proximity is a leaf."""
    clauses = n.children if isinstance(n, (And, Or)) else (n.child,) if isinstance(n, Not) else ()
    return step(n, [fold(c, step) for c in clauses])
