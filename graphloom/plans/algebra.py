"""SPARQL algebra as plain data; the parser makes it, the compiler reads it."""

from __future__ import annotations

from dataclasses import dataclass, field

from graphloom.functions.terms import BNode, Iri, Literal, Term, Var


class Node:
    """Of the algebra."""


class Expr:
    """An expression."""


@dataclass(frozen=True)
class Call(Expr):
    """A built-in, an operator or a function IRI, with arguments."""

    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Const(Expr):
    term: Iri | Literal


@dataclass(frozen=True)
class Ref(Expr):
    var: str


@dataclass(frozen=True)
class Exists(Expr):
    pattern: Node
    negated: bool = False


@dataclass(frozen=True)
class Agg(Expr):
    name: str
    arg: Expr | None
    distinct: bool = False
    separator: str = " "


@dataclass(frozen=True)
class Triple:
    s: Term
    p: Term
    o: Term

    def __iter__(self):
        return iter((self.s, self.p, self.o))

    def __str__(self) -> str:
        return " ".join(map(str, self))


@dataclass(frozen=True)
class BGP(Node):
    triples: tuple[Triple, ...] = ()


@dataclass(frozen=True)
class Path(Node):
    """``way``: ("p", IRI), ("^", way), ("/" or "|", ways...), ("+", "*" or "?", way)."""

    s: Term
    way: tuple
    o: Term


@dataclass(frozen=True)
class Join(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class LeftJoin(Node):
    left: Node
    right: Node
    expr: Expr | None = None


@dataclass(frozen=True)
class Filter(Node):
    expr: Expr
    part: Node


@dataclass(frozen=True)
class Union(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Minus(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Extend(Node):
    part: Node
    var: str
    expr: Expr


@dataclass(frozen=True)
class Values(Node):
    vars: tuple[str, ...]
    rows: tuple[tuple[Term | None, ...], ...]


@dataclass(frozen=True)
class Graph(Node):
    name: Term
    part: Node


@dataclass(frozen=True)
class Group(Node):
    """Keys are (variable, expression); aggregates are (variable, Agg)."""

    part: Node
    keys: tuple[tuple[str, Expr], ...]
    aggs: tuple[tuple[str, Agg], ...]


@dataclass(frozen=True)
class Project(Node):
    part: Node
    vars: tuple[str, ...]


@dataclass(frozen=True)
class Distinct(Node):
    part: Node


@dataclass(frozen=True)
class Reduced(Node):
    part: Node


@dataclass(frozen=True)
class OrderBy(Node):
    part: Node
    keys: tuple[tuple[Expr, bool], ...]  # (expression, descending)


@dataclass(frozen=True)
class Slice(Node):
    part: Node
    start: int
    length: int | None


@dataclass(frozen=True)
class Service(Node):
    part: Node


@dataclass
class Query:
    form: str  # select, ask, construct, describe
    part: Node
    vars: tuple[str, ...] = ()
    template: tuple[Triple, ...] = ()
    prefixes: dict[str, str] = field(default_factory=dict)
    base: str = ""
    default_graphs: tuple[str, ...] = ()
    named_graphs: tuple[str, ...] = ()


def visible(n: Node) -> list[str]:
    """Variables in scope, in order of appearance, without those of blank nodes."""
    out: dict[str, None] = {}

    def walk(n: Node) -> None:
        if isinstance(n, BGP):
            for t in n.triples:
                for x in t:
                    if isinstance(x, Var) and not x.name.startswith("_"):
                        out[x.name] = None
        elif isinstance(n, Path):
            for x in (n.s, n.o):
                if isinstance(x, Var) and not x.name.startswith("_"):
                    out[x.name] = None
        elif isinstance(n, (Join, LeftJoin, Union)):
            walk(n.left)
            walk(n.right)
        elif isinstance(n, Minus):
            walk(n.left)
        elif isinstance(n, Extend):
            walk(n.part)
            out[n.var] = None
        elif isinstance(n, Values):
            out.update(dict.fromkeys(n.vars))
        elif isinstance(n, Graph):
            if isinstance(n.name, Var):
                out[n.name.name] = None
            walk(n.part)
        elif isinstance(n, Group):
            out.update(dict.fromkeys(k for k, _ in n.keys if not k.startswith("_")))
        elif isinstance(n, Project):
            out.update(dict.fromkeys(n.vars))
        elif hasattr(n, "part"):
            walk(n.part)

    walk(n)
    return list(out)


def bgps(n: Node) -> list[tuple[BGP, list[Expr]]]:
    """Basic graph patterns with the single-variable filters that apply to each."""
    out: list[tuple[BGP, list[Expr]]] = []

    def walk(n: Node, filters: list[Expr]) -> None:
        if isinstance(n, BGP):
            if n.triples:
                own = {x.name for t in n.triples for x in t if isinstance(x, Var)}
                out.append((n, [f for f in filters if len(free(f)) == 1 and free(f) <= own]))
        elif isinstance(n, Filter):
            walk(n.part, filters + conjuncts(n.expr))
        elif isinstance(n, LeftJoin):
            walk(n.left, filters)
            walk(n.right, conjuncts(n.expr) if n.expr else [])
        elif isinstance(n, (Join, Union)):
            walk(n.left, filters)
            walk(n.right, filters)
        elif isinstance(n, Minus):
            walk(n.left, filters)
            walk(n.right, [])
        elif isinstance(n, (Project, Group, Extend, Slice)):
            walk(n.part, [])
        elif hasattr(n, "part"):
            walk(n.part, filters)

    walk(n, [])
    return out


def conjuncts(e: Expr) -> list[Expr]:
    return conjuncts(e.args[0]) + conjuncts(e.args[1]) if isinstance(e, Call) and e.name == "&&" else [e]


def free(e: Expr) -> set[str]:
    """Variables of an expression; those of EXISTS patterns count as many, so that it is never taken for a simple filter."""
    if isinstance(e, Ref):
        return {e.var}
    if isinstance(e, Call):
        return set().union(*(free(a) for a in e.args)) if e.args else set()
    if isinstance(e, Exists):
        return {"*exists", *visible(e.pattern)}
    if isinstance(e, Agg):
        return free(e.arg) if e.arg else set()
    return set()


def bnode_var(b: BNode) -> Var:
    """Blank nodes of a pattern are variables that are never visible."""
    return Var(f"_{b.label}")
