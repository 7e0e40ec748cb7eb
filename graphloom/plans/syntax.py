"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class QueryError(ValueError):
    """A query that is malformed or breaks a static rule."""


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True, eq=False)
class Lit(Expr):
    value: Any

    def __eq__(self, other: object) -> bool:  # 1, 1.0 and true are different literals
        return isinstance(other, Lit) and type(self.value) is type(other.value) and self.value == other.value

    def __hash__(self) -> int:
        return hash((type(self.value), self.value))


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    base: Expr
    name: str


@dataclass(frozen=True)
class Index(Expr):
    base: Expr
    at: Expr


@dataclass(frozen=True)
class Slice(Expr):
    base: Expr
    low: Expr | None
    high: Expr | None


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapOf(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    x: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    a: Expr
    b: Expr


@dataclass(frozen=True)
class Chain(Expr):
    """a < b <= c: every neighbouring pair must hold."""

    first: Expr
    rest: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class IsNull(Expr):
    x: Expr
    negated: bool


@dataclass(frozen=True)
class HasLabels(Expr):
    x: Expr
    labels: tuple[str, ...]


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class Comprehension(Expr):
    var: str
    source: Expr
    where: Expr | None
    result: Expr | None


@dataclass(frozen=True)
class PatternComprehension(Expr):
    pattern: PathPattern
    where: Expr | None
    result: Expr


@dataclass(frozen=True)
class Quantifier(Expr):
    kind: str
    var: str
    source: Expr
    where: Expr


@dataclass(frozen=True)
class Reduce(Expr):
    acc: str
    start: Expr
    var: str
    source: Expr
    step: Expr


# ---- patterns ---------------------------------------------------------------


@dataclass(frozen=True)
class NodePattern:
    var: str
    named: bool
    labels: tuple[str, ...] = ()
    props: Expr | None = None


@dataclass(frozen=True)
class RelPattern:
    var: str
    named: bool
    types: tuple[str, ...] = ()
    direction: str = "out"  # out, in, both
    span: tuple[int, int | None] | None = None
    props: Expr | None = None


@dataclass(frozen=True)
class PathPattern:
    var: str | None
    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern, ...]


# ---- clauses ----------------------------------------------------------------


@dataclass
class Item:
    expr: Expr
    name: str
    aliased: bool


@dataclass
class Projection:
    items: list[Item]
    star: bool = False
    distinct: bool = False
    order: list[tuple[Expr, bool]] = field(default_factory=list)  # (key, ascending)
    skip: Expr | None = None
    limit: Expr | None = None


@dataclass
class Match:
    patterns: list[PathPattern]
    optional: bool = False
    where: Expr | None = None


@dataclass
class Unwind:
    expr: Expr
    var: str


@dataclass
class With:
    body: Projection
    where: Expr | None = None


@dataclass
class Return:
    body: Projection


@dataclass
class CallProcedure:
    name: str
    args: list[Expr] | None
    yields: list[tuple[str, str]] | None  # None: no YIELD; []: YIELD *
    where: Expr | None = None


@dataclass
class Create:
    patterns: list[PathPattern]


@dataclass
class Merge:
    pattern: PathPattern
    on_create: list
    on_match: list


@dataclass
class SetProperty:
    var: str
    name: str
    value: Expr


@dataclass
class SetLabels:
    var: str
    labels: tuple[str, ...]


@dataclass
class SetClause:
    items: list


@dataclass
class RemoveClause:
    items: list  # SetProperty with a null value, or SetLabels


@dataclass
class Delete:
    targets: list[Expr]
    detach: bool


@dataclass
class Foreach:
    var: str
    source: Expr
    body: list


@dataclass
class Single:
    clauses: list


@dataclass
class Union:
    left: Any
    right: Single
    all: bool


@dataclass
class Copy:
    target: str
    path: str
    options: dict[str, Any]


@dataclass
class Export:
    path: str
    options: dict[str, Any]


@dataclass
class Import:
    path: str


@dataclass
class Ddl:
    action: str  # create / drop
    kind: str  # index / unique / required
    on: str  # node / relationship
    label: str
    prop: str
    name: str | None = None


# ---- walking ----------------------------------------------------------------


def children(e: Any) -> list[Expr]:
    """Direct subexpressions (pattern property maps included)."""
    if e is None:
        return []
    if isinstance(e, PathPattern):
        return [p.props for p in (*e.nodes, *e.rels) if p.props is not None]
    if isinstance(e, PatternComprehension):
        return [x for x in (*children(e.pattern), e.where, e.result) if x is not None]
    out: list[Expr] = []
    for value in vars(e).values():
        stack = [value]
        while stack:
            v = stack.pop()
            if isinstance(v, Expr):
                out.append(v)
            elif isinstance(v, tuple):
                stack += v
    return out


def walk(e: Any):
    yield e
    for c in children(e):
        yield from walk(c)
