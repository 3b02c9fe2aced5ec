"""Tables as classes: a direct mapping of columns to properties.

Subjects keep the table's key as a native column; their IRI is the class's prefix
and the key, made only where it is shown.  Triple patterns about one subject are
one scan of its table, so that constants and filters are pushed into the scan and
only the columns in use are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import expressions as E
from graphloom.functions import values as V
from graphloom.functions.terms import RDF_TYPE, BNode, Iri, Literal, Term, Var
from graphloom.functions.values import Kind
from graphloom.operators import solutions as S
from graphloom.plans.algebra import Triple


@dataclass(frozen=True)
class TableClass:
    """``key``: SQL expression of the subject's key; ``links``: property → (key expression, class).

    ``rowwise``: each row is a resource of its own, whose key is made of all its links, so that rows of one key have the same ones.
    """

    iri: str
    table: str
    key: str
    prefix: str
    properties: dict[str, str] = field(default_factory=dict)
    links: dict[str, tuple[str, str]] = field(default_factory=dict)
    rowwise: bool = False


@dataclass
class Mapping:
    classes: dict[str, TableClass]
    read: Callable[[str], DataFrame]
    inverses: dict[str, str] = field(default_factory=dict)  # property → the property that is stored
    subclasses: dict[str, tuple[str, ...]] = field(default_factory=dict)  # class → all below it, itself excluded
    reasoning: bool = True

    def of_class(self, iri: str) -> list[TableClass]:
        names = [iri, *(self.subclasses.get(iri, ()) if self.reasoning else ())]
        return [self.classes[n] for n in names if n in self.classes]

    def having(self, prop: str) -> list[TableClass]:
        return [c for c in self.classes.values() if prop in c.properties or prop in c.links]

    def frame(self, c: TableClass) -> DataFrame:
        return self.read(c.table)

    def key_type(self, c: TableClass) -> str:
        return self.frame(c).select(F.expr(c.key).alias("k")).schema[0].dataType.simpleString()

    # Patterns

    def direct(self, t: Triple) -> Triple:
        """A pattern on an inverse property, turned around."""
        if isinstance(t.p, Iri) and t.p.value in self.inverses:
            return Triple(t.o, Iri(self.inverses[t.p.value]), t.s)
        return t

    def bgp(self, triples: tuple[Triple, ...], spark) -> S.Solutions:
        stars: dict[Term, list[Triple]] = {}
        free = [t for t in triples if not isinstance(t.p, Iri)]
        for t in map(self.direct, triples):
            if isinstance(t.p, Iri):
                stars.setdefault(t.s, []).append(t)
        options = {s: self._tables(s, own) for s, own in stars.items()}
        # A link's class says which tables its object can be in; to a fixed point.
        changed = True
        while changed:
            changed = False
            for s, own in stars.items():
                for t in own:
                    if t.o not in stars or t.p.value == RDF_TYPE or isinstance(t.o, Literal):
                        continue
                    targets = {c.links[t.p.value][1] for c in options[s] if t.p.value in c.links}
                    allowed = {x.iri for iri in targets for x in [self.classes.get(iri), *(self.classes.get(b) for b in self.subclasses.get(iri, ()))] if x}
                    kept = [c for c in options[t.o] if c.iri in allowed]
                    changed |= len(kept) < len(options[t.o])
                    options[t.o] = kept
        scans = [self._star(s, own, options[s], spark) for s, own in stars.items()]
        # Predicates to be found: one scan of each class that the subject can be of.
        scans += [self._any(t, options.get(t.s, list(self.classes.values())), spark) for t in free]
        return S.join_all(scans, spark)

    def _any(self, t: Triple, tables: list[TableClass], spark) -> S.Solutions:
        """All properties of a subject, turned into rows; what is known of subject and object keeps classes, columns and rows out."""
        parts = [p for c in tables if (p := self._unpivot(t, c)) is not None]
        if parts:
            return reduce(S.union, parts)
        return S.nothing([x.name for x in dict.fromkeys(t) if isinstance(x, Var)], spark)

    def _unpivot(self, t: Triple, c: TableClass) -> S.Solutions | None:
        if isinstance(t.s, Literal) or isinstance(t.s, Iri) and not t.s.value.startswith(c.prefix):
            return None
        df, key = self.frame(c), Kind("iri", c.prefix, True, self.key_type(c))
        types = dict(df.dtypes)
        if isinstance(t.s, Iri):
            df = df.filter(F.expr(c.key) == F.lit(t.s.value.removeprefix(c.prefix)).try_cast(key.key))
        found: list[tuple[str, Column, Kind]] = [(RDF_TYPE, F.lit(c.iri), V.FULL_IRI)]
        for p, n in c.properties.items():
            kind = V.of_sql(types[n])
            found.append((p, V.native(F.col(n), kind), kind))
        for p, (k, target) in c.links.items():
            to = self.classes.get(target)
            found.append((p, F.expr(k), Kind("iri", to.prefix if to else f"{target}/", True, df.select(F.expr(k).alias("k")).schema[0].dataType.simpleString())))
        if not isinstance(t.o, Var):
            found = [f for f in found if f[0] != RDF_TYPE or t.o == Iri(c.iri)]
            tests = [(p, col, kind, x) for p, col, kind in found if (x := self._constant(t.o, col, kind)) is not None]
            if not tests:
                return None
            if all(p != RDF_TYPE for p, *_ in tests):
                df = df.filter(reduce(lambda a, b: a | b, (x for *_, x in tests)))  # reaches the scan
            pairs = [F.when(x, F.lit(p)) for p, _, _, x in tests]
            rows = df.select(F.expr(c.key).alias("_s"), F.explode(F.array(*pairs)).alias("_p"), F.lit(None).cast("string").alias("_o")).filter("_p is not null")
        else:
            pairs = [F.struct(F.lit(p).alias("p"), V.as_term(col, kind).alias("o")) for p, col, kind in found]
            rows = df.select(F.expr(c.key).alias("_s"), F.explode(F.array(*pairs)).alias("e")).select("_s", F.col("e.p").alias("_p"), F.col("e.o").alias("_o")).filter("_o.lex is not null")
        bound: dict[str, tuple[Column, Kind]] = {}
        for x, col, kind in ((t.s, F.col("_s"), key), (t.p, F.col("_p"), V.FULL_IRI), (t.o, F.col("_o"), V.TERM_KIND)):
            if not isinstance(x, Var):
                continue
            if x.name in bound:
                rows = rows.filter(V.as_term(*bound[x.name]) == V.as_term(col, kind))
            else:
                bound[x.name] = (col, kind)
        return S.Solutions(rows.select(*(col.alias(S.column(n)) for n, (col, _) in bound.items())), {n: k for n, (_, k) in bound.items()})

    @staticmethod
    def _constant(x: Term, col: Column, kind: Kind) -> Column | None:
        """Whether a column holds a constant, or None if its kind cannot."""
        if kind.name == "iri":
            if not isinstance(x, Iri) or not x.value.startswith(kind.prefix):
                return None
            return col == F.lit(x.value.removeprefix(kind.prefix)).try_cast(kind.key)
        if not isinstance(x, Literal):
            return None
        want, other = E.constant(x)
        return col == V.convert(want, other, V.meet(other, kind)) if other.name == kind.name or {other.name, kind.name} <= set(V.NUMBERS) else None

    def _tables(self, s: Term, own: list[Triple]) -> list[TableClass]:
        found: list[TableClass] | None = None
        for t in own:
            if t.p.value == RDF_TYPE:
                fits = self.of_class(t.o.value) if isinstance(t.o, Iri) else list(self.classes.values()) if isinstance(t.o, Var) else []
            else:
                fits = self.having(t.p.value)
            found = fits if found is None else [c for c in found if c in fits]
        if isinstance(s, Iri):
            found = [c for c in found if s.value.startswith(c.prefix)]
        return found if not isinstance(s, Literal) else []

    def _star(self, s: Term, own: list[Triple], tables: list[TableClass], spark) -> S.Solutions:
        names = {x.name for t in own for x in (t.s, t.o) if isinstance(x, Var)}
        parts = [self._scan(s, own, c) for c in tables]
        if not parts:
            return S.nothing(sorted(names), spark)
        out = reduce(S.union, parts)
        return out

    def _scan(self, s: Term, own: list[Triple], c: TableClass) -> S.Solutions:
        """One table's answers to all patterns about one subject."""
        df = self.frame(c)
        types = dict(df.dtypes)
        key_kind = Kind("iri", c.prefix, True, self.key_type(c))
        bound: dict[str, tuple[Column, Kind]] = {}
        tests: list[Column] = []

        def meet(x: Term, col: Column, kind: Kind) -> None:
            if isinstance(x, Var):
                if x.name in bound:
                    tests.append(E.equal(bound[x.name], (col, kind)))
                else:
                    bound[x.name] = (col, kind)
            elif isinstance(x, BNode):
                tests.append(F.lit(False))
            elif kind.name == "iri":
                if isinstance(x, Iri) and x.value.startswith(kind.prefix):
                    tests.append(col == F.lit(x.value.removeprefix(kind.prefix)).try_cast(kind.key))
                else:
                    tests.append(F.lit(False))
            else:
                want, other = E.constant(x)
                fits = other.name == kind.name or {other.name, kind.name} <= set(V.NUMBERS)
                tests.append(col == V.convert(want, other, V.meet(other, kind)) if fits else F.lit(False))

        meet(s, F.expr(c.key), key_kind)
        for t in own:
            p = t.p.value
            if p == RDF_TYPE:
                meet(t.o, F.lit(c.iri), V.FULL_IRI) if isinstance(t.o, Var) else None
            elif p in c.links:
                key, target = c.links[p]
                to = self.classes.get(target)
                kind = Kind("iri", to.prefix if to else f"{target}/", True, df.select(F.expr(key).alias("k")).schema[0].dataType.simpleString())
                tests.append(F.expr(key).isNotNull())
                meet(t.o, F.expr(key), kind)
            else:
                name = c.properties[p]
                tests.append(F.col(name).isNotNull())
                kind = V.of_sql(types[name])
                meet(t.o, V.native(F.col(name), kind), kind)
        for x in tests:
            df = df.filter(x)
        if not bound:
            return S.Solutions(df.select(), {})
        return S.Solutions(df.select(*(col.alias(S.column(n)) for n, (col, _) in bound.items())), {n: k for n, (_, k) in bound.items()})


def triples_of(m: Mapping, classes: list[str] | None = None) -> DataFrame:
    """The mapped tables as generic triples (g, s, p, o); g is the class."""
    parts = []
    for c in m.classes.values():
        if classes is not None and c.iri not in classes:
            continue
        df = m.frame(c)
        types = dict(df.dtypes)
        s = V.as_term(F.expr(c.key), Kind("iri", c.prefix))
        items = [(RDF_TYPE, V.as_term(F.lit(c.iri), V.FULL_IRI))]
        items += [(p, V.as_term(V.native(F.col(n), V.of_sql(types[n])), V.of_sql(types[n]))) for p, n in c.properties.items()]
        items += [(p, V.as_term(F.expr(k), Kind("iri", m.classes[t].prefix if t in m.classes else f"{t}/"))) for p, (k, t) in c.links.items()]
        pairs = F.array(*(F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in items))
        parts.append(df.select(F.lit(c.iri).alias("g"), s.alias("s"), F.explode(pairs).alias("e")).select("g", "s", "e.p", "e.o").filter("o is not null"))
    return reduce(DataFrame.unionByName, parts)
