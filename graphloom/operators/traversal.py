"""Link traversal, a set at a time.

What a crawler does one resource after the other is a chain of joins here: the
seeds are a table, following a property is an equi-join with its pairs, and a
cycle is a loop over the newly reached keys until there are none.  On its way through a tree or
cycle a resource goes on once from each place, whatever led there; over tables, rows that are
resources of their own are passed in one scan, without their keys.  A long chain along functional properties is reached by pointer doubling, in as many rounds as its length has binary digits.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import values as V
from graphloom.functions.terms import RDF_TYPE, Iri, Literal, Term, Var
from graphloom.functions.values import Kind
from graphloom.operators import chains
from graphloom.operators import solutions as S
from graphloom.operators.solutions import Solutions
from graphloom.operators.vocabulary import Vocabulary
from graphloom.plans import algebra as A
from graphloom.plans.algebra import Triple
from graphloom.plans.planner import Plan, Space, Tree
from graphloom.sources.store import Rounds, checkpoint

AT, TO = "at", "to"
#: Rounds of a cycle before doubling is tried, and between two rewrites of what was reached.
PATIENCE = 8
#: Bytes of keys that are broadcast to the joins of a step.
LIGHT_BYTES = 16_000_000

#: The steps from a place to the root: (classes that take a step, or None for any; its property, or two that lead through a row).
Route = tuple[tuple[frozenset[str] | None, tuple[str, ...]], ...]


def _one(s: Solutions, var: str, name: str) -> Solutions:
    """One variable of a table, renamed, as a set."""
    return Solutions(s.df.select(s.col(var).alias(S.column(name))).distinct(), {name: s.kinds[var]})


class Traversal:
    def __init__(self, spark: SparkSession, data, vocab: Vocabulary, most_rounds: int | None = None):
        self.spark, self.data, self.vocab, self.most_rounds = spark, data, vocab, most_rounds
        self.rounds: list[int] = []  # newly reached resources of each round of a cycle

    def seeds(self, tree: Tree) -> Solutions:
        """The seeds, typed as the data types their class."""
        from graphloom.sources.mapping import Mapping

        if isinstance(self.data, Mapping):
            parts = []
            for c in self.data.of_class(tree.from_type):
                keys = [(s.removeprefix(c.prefix),) for s in tree.seeds if s.startswith(c.prefix)]
                kind = self.data.key_type(c)
                df = self.spark.createDataFrame(keys, "k string").select(F.col("k").try_cast(kind).alias(S.column(AT)))
                parts.append(Solutions(df.filter(F.col(S.column(AT)).isNotNull()), {AT: Kind("iri", c.prefix, True, kind)}))
            if parts:
                return reduce(S.union, parts)
        df = self.spark.createDataFrame([(s,) for s in tree.seeds], "k string")
        full = Solutions(df.select(F.col("k").alias(S.column(AT))), {AT: V.FULL_IRI})
        return full if isinstance(self.data, Mapping) else full.to({AT: V.TERM_KIND})

    def _ways(self, prop: str) -> list[Triple]:
        """A property and the inverses of it that the data does not turn around by itself."""
        ways = [Triple(Var(AT), Iri(prop), Var(TO))]
        stored = getattr(self.data, "inverses", {})
        for q in sorted(self.vocab.facts.inverses(prop)):
            if stored.get(prop) != q and stored.get(q) != prop:
                ways.append(Triple(Var(TO), Iri(q), Var(AT)))
        return ways

    def follow(self, at: Solutions, prop: str) -> Solutions:
        """What the property, or an inverse of it, leads to."""
        found = [_one(S.semi(self.data.bgp((t,), self.spark), at), TO, AT) for t in self._ways(prop)]
        found = [f for f in found if f.kinds]
        return reduce(S.union, found).distinct()

    def _turn(self, props: list[str]) -> Solutions:
        """(at, to) over the whole data: where following these properties leads from each resource."""
        out = None
        for p in props:
            step = reduce(S.union, [self.data.bgp((t,), self.spark) for t in self._ways(p)])
            if out is None:
                out = step
            else:
                both = S.join(_renamed(out, {TO: "between"}), _renamed(step, {AT: "between"}))
                out = Solutions(both.df.select(both.col(AT), both.col(TO)), {v: both.kinds[v] for v in (AT, TO)})
        return out

    def gate(self, at: Solutions, types: frozenset[str]) -> Solutions:
        """Those that can be of one of these classes.

        Over tables a resource's IRI tells its class.  Over triples its types do, subclasses and superclasses fitting; a
        resource without any type passes.
        """
        from graphloom.sources.mapping import Mapping

        if not types:
            return at
        wide = types | {s for t in types for s in self.vocab.facts.subtypes(t)}
        kind = at.kinds[AT]
        if isinstance(self.data, Mapping):
            prefixes = sorted({c.prefix for c in self.data.classes.values() if c.iri in wide})
            if not prefixes or kind.name != "iri":
                return at
            if kind.prefix:
                return at if kind.prefix in prefixes else Solutions(at.df.filter(F.lit(False)), at.kinds)
            return Solutions(at.df.filter(reduce(lambda a, b: a | b, (F.startswith(at.col(AT), F.lit(p)) for p in prefixes))), at.kinds)
        wide |= {s for t in types for s in self.vocab.facts.supertypes(t)}
        typed = self.data.bgp((Triple(Var(AT), Iri(RDF_TYPE), Var(TO)),), self.spark)
        fits = Solutions(typed.df.filter(V.as_term(typed.col(TO), typed.kinds[TO])["lex"].isin(*sorted(wide))), typed.kinds)
        return S.union(S.semi(at, _one(fits, AT, AT)), S.semi(at, _one(typed, AT, AT), anti=True))

    # Routes

    def _begin(self, prop: str) -> set[str] | None:
        """Classes of tables whose resources can have a property; None if that is not known."""
        out: set[str] = set()
        for t in map(self.data.direct, self._ways(prop)):
            tables = self.data.having(t.p.value)
            if t.s == Var(AT):
                out |= {c.iri for c in tables}
                continue
            targets = {c.links[t.p.value][1] for c in tables if t.p.value in c.links}
            if not targets <= set(self.data.classes):
                return None
            out |= targets
        return out

    def _through(self, first: str, types: frozenset[str], then: str) -> bool:
        """Whether two steps lead through rows of one table that are resources of their own."""
        ways = [*self._ways(first), *self._ways(then)]
        back = self.data.direct(ways[0])
        tables = self.data.having(back.p.value)
        if len(ways) != 2 or back.s != Var(TO) or self.data.direct(ways[1]) != ways[1] or len(tables) != 1:
            return False
        c = tables[0]
        wide = types | {s for t in types for s in self.vocab.facts.subtypes(t)}
        return c.rowwise and back.p.value in c.links and then in c.links and (not types or c.iri in wide)

    def _route(self, steps: list[tuple[frozenset[str], str]]) -> Route:
        """Steps by the places between them; a gate that keeps out only what has not the property is left out."""
        from graphloom.sources.mapping import Mapping

        if not isinstance(self.data, Mapping):
            return tuple((types or None, (p,)) for types, p in steps)
        out: list[tuple[frozenset[str] | None, tuple[str, ...]]] = []
        i = 0
        while i < len(steps):
            types, p = steps[i]
            wide = types | {s for t in types for s in self.vocab.facts.subtypes(t)}
            can = self._begin(p)
            n = 2 if i + 1 < len(steps) and self._through(p, *steps[i + 1]) else 1
            out.append((types if types and (can is None or not can <= wide) else None, tuple(q for _, q in steps[i : i + n])))
            i += n
        return tuple(out)

    def _light(self, x: Solutions, n: int) -> Solutions:
        """A saved set of n keys, broadcast if it is small."""
        from graphloom.sources.mapping import Mapping

        k = x.kinds[AT]
        wide = 16 if k.name == "iri" and k.key in ("tinyint", "smallint", "int", "bigint") else 128
        return Solutions(F.broadcast(x.df), x.kinds) if isinstance(self.data, Mapping) and n * wide <= LIGHT_BYTES else x

    def _hop(self, at: Solutions, hop: tuple[str, ...], after: str | None = None, known: Solutions | None = None, last: bool = False) -> Solutions:
        """What a step of a route leads to: over tables only what can go on by ``after`` and is not ``known``; the last step's is no set yet."""
        from graphloom.sources.mapping import Mapping

        if not isinstance(self.data, Mapping):
            return self.follow(at, hop[0])
        if len(hop) == 2:
            link = self.data.direct(self._ways(hop[0])[0]).p
            patterns = [(Triple(Var("row"), link, Var(AT)), Triple(Var("row"), Iri(hop[1]), Var(TO)))]
        else:
            patterns = [(t,) for t in self._ways(hop[0])]
        own = {c.iri for c in self.data.classes.values() if at.kinds[AT].prefix and c.prefix == at.kinds[AT].prefix}
        can = self._begin(after) if after else None
        found = []
        for triples in patterns:
            t = self.data.direct(triples[0])
            tables = {c.iri for c in self.data.having(t.p.value)}
            only = own if t.s == Var(AT) else can & tables if t.s == Var(TO) and can else set()
            if len(only) == 1 and len(tables) > 1 and len(hop) == 1:
                triples = (*triples, Triple(t.s, Iri(RDF_TYPE), Iri(*only)))
            pairs = self.data.bgp(triples, self.spark)
            if known is not None:
                pairs = S.semi(pairs, _renamed(known, {AT: TO}), anti=True)
            out = _renamed(_part(S.semi(_part(pairs, AT, TO), at), TO), {TO: AT})
            found.append(out)
        out = reduce(S.union, found)
        return out if last else out.distinct()

    def _walk(self, at: Solutions, route: Route, known: dict[Route, tuple[Solutions, int]], first: Solutions | None = None) -> Solutions | None:
        """Where a route leads; at each place only what has not stood there yet goes on.  ``first``: what its first step leads to, where that is saved."""
        for i, (types, hop) in enumerate(route):
            if i == 0 and types:
                at = self.gate(at, types)
            rest = route[i + 1 :]
            seen, n = known.get(rest, (None, 0))
            if i == 0 and first is not None:
                step = first
            else:
                light = self._light(seen, n) if seen is not None else None
                step = self._hop(at, hop, rest[0][1][0] if rest else None, light if light is not seen else None, not rest)
            if not step.kinds:  # the property leads nowhere in this data
                return None
            if not rest:
                return step
            step = self.gate(step, rest[0][0] or frozenset())
            if seen is not None:
                kind = V.meet(step.kinds[AT], seen.kinds[AT])
                step, seen = (x if x.kinds[AT].like(kind) else x.to({AT: kind}) for x in (step, seen))
                step = Solutions(step.df.join(seen.df, S.column(AT), "left_anti"), step.kinds)
            new = Solutions(checkpoint(step.df), step.kinds)
            more = new.df.count()
            if not more:
                return None
            known[rest] = (new if seen is None else Solutions(seen.df.unionByName(new.df), new.kinds), n + more)
            at = self._light(new, more)
        return at

    def reach(self, *trees: Tree, types: frozenset[str] = frozenset()) -> Solutions:
        """All resources in the place of a root, by trees that share it and its cycles.

        On the way only resources of the class that a step expects are followed; ``types`` are the root's own.
        """
        known: dict[Route, tuple[Solutions, int]] = {}
        found = [self._walk(self.seeds(tree), self._route([(frozenset((c,)), p) for c, p in tree.steps]), known) for tree in trees]
        found = [f for f in found if f is not None]
        if not found:
            return S.nothing([AT], self.spark)
        at = reduce(S.union, found)
        if not trees[0].cycles:
            return self.gate(at, types).distinct()
        return self.gate(self._closed(at, [[p for _, p in c] for c in trees[0].cycles], known), types)

    def fixpoint(self, at: Solutions, *cycles: list[str]) -> Solutions:
        """Follow each list of properties until nothing new is reached; each round is one job that cuts the lineage.

        More rounds than ``most_rounds``, where it is set, are an error.
        """
        return self._closed(at, list(cycles), {})

    def _closed(self, at: Solutions, cycles: list[list[str]], known: dict[Route, tuple[Solutions, int]]) -> Solutions:
        seen = Solutions(checkpoint(at.df.distinct()), at.kinds)
        routes = [self._route([(frozenset(), p) for p in props]) for props in cycles]
        # Through a row and back by the same link leads to where it began.
        routes = [r for r in routes if not all(len(hop) == 2 and self.data.inverses.get(hop[0]) == hop[1] for _, hop in r)]
        shared = {r[0][1] for r in routes if sum(r[0][1] == q[0][1] and len(q) > 1 for q in routes) > 1}
        frontier, parts = seen, 1
        if any(len(r) > 1 for r in routes):
            frontier = self._light(seen, seen.df.count())
        for done in count():
            if done == self.most_rounds:
                raise RuntimeError(f"no end of the cycle after {done} rounds")
            if done == PATIENCE and (pairs := self._functional(cycles, seen.kinds[AT])) is not None:
                return self._doubled(seen, pairs)
            firsts = {hop: self._saved(self._hop(frontier, hop)) for hop in sorted(shared)}
            ends = [x for r in routes if (x := self._walk(frontier, r, known, firsts.get(r[0][1]) if len(r) > 1 else None)) is not None]
            if not ends:
                self.rounds.append(0)
                return seen
            step = reduce(S.union, ends)
            if not step.kinds[AT].like(seen.kinds[AT]):
                kind = V.meet(step.kinds[AT], seen.kinds[AT])
                step, seen = step.to({AT: kind}), seen.to({AT: kind})
            new = checkpoint(step.df.distinct().join(seen.df, S.column(AT), "left_anti"))
            n = new.count()
            self.rounds.append(n)
            if not n:
                return seen
            frontier, parts = self._light(Solutions(new, seen.kinds), n), parts + 1
            both = seen.df.unionByName(new)  # of tables that are cut already; only the frontier is written
            seen = Solutions(checkpoint(both) if parts % PATIENCE == 0 else both, seen.kinds)

    def _functional(self, cycles: tuple[list[str], ...], kind: Kind) -> Solutions | None:
        """One turn of any cycle as saved pairs, if every resource has one way on at most.

        Each property is looked at by itself first: where one leads to many, a whole turn may have far more pairs than the data.
        """
        for p in sorted({p for props in cycles for p in props}):
            step = self._turn([p])
            if set(step.kinds) != {AT, TO} or not step.df.groupBy(S.column(AT)).agg(F.count_distinct(S.column(TO)).alias("n")).filter("n > 1").isEmpty():
                return None
        pairs = reduce(S.union, [self._turn(props) for props in cycles])
        if set(pairs.kinds) != {AT, TO}:
            return None
        kind = reduce(V.meet, (pairs.kinds[AT], pairs.kinds[TO], kind)).sure()
        pairs = pairs.to({AT: kind, TO: kind})
        pairs = Solutions(checkpoint(pairs.df.distinct()), pairs.kinds)
        more = pairs.df.groupBy(S.column(AT)).count().filter("count > 1")
        return pairs if more.isEmpty() else None

    def _doubled(self, seen: Solutions, pairs: Solutions) -> Solutions:
        """All that a functional relation leads to; over whole-numbered keys in order, blocks of keys are walked in one task and only what leads out of them is doubled."""
        kind = pairs.kinds[AT]
        tables, starts = Rounds(self.spark), seen.to({AT: kind}).df.dropna()
        pairs = Solutions(pairs.df.dropna(), pairs.kinds)
        if kind.name != "iri" or kind.key not in ("int", "bigint") or not chains.dense(pairs.df):
            return Solutions(self._jumped(starts, pairs.df, tables), {AT: kind})
        jump = tables.save(chains.across(pairs.df, chains.entries(pairs.df, starts)))
        return Solutions(tables.save(chains.within(pairs.df, self._jumped(starts, jump, tables))), {AT: kind})

    def _jumped(self, reached: DataFrame, jump: DataFrame, tables: Rounds) -> DataFrame:
        """After k rounds the pairs lead 2^k turns on, and all within 2^k turns of the start is reached."""
        a, b = jump.columns
        reached = tables.save(reached)
        for done in count(1):
            step = jump.join(reached, a, "left_semi").select(F.col(b).alias(a))
            new = tables.save(step.distinct().join(reached, a, "left_anti"))
            n = new.count()
            self.rounds.append(n)
            if not n:
                return reached
            both = reached.unionByName(new)
            reached = tables.save(both, both) if done % PATIENCE == 0 else both
            on = jump.select(F.col(a).alias(b), F.col(b).alias("next"))
            jump = tables.save(jump.join(on, b).select(a, F.col("next").alias(b)), jump)

    def _sure(self, space: Space, root: Var) -> bool:
        """Whether the patterns themselves lead from a seed to this root, by the steps of a tree: then all their answers are reached."""
        from graphloom.sources.mapping import Mapping

        def wide(types: frozenset[str]) -> set[str]:
            return types | {s for t in types for s in self.vocab.facts.subtypes(t)}

        def back(prop: str, at: Term) -> list[tuple[Term, bool]]:
            """Nodes from which a pattern leads to this one by the property, and whether the root's classes allow what it leads to."""
            out = []
            for way in map(self.data.direct, self._ways(prop)):
                for t in map(self.data.direct, space.agp.patterns):
                    if t.p == way.p and (t.o if way.s == Var(AT) else t.s) == at:
                        ends = {c.links[t.p.value][1] for c in self.data.having(t.p.value) if t.p.value in c.links} if way.s == Var(AT) else {c.iri for c in self.data.having(t.p.value)}
                        out.append((t.s if way.s == Var(AT) else t.o, ends <= set(self.data.classes) and (not types or ends <= wide(types))))
            return out

        def leads(at: Term, steps: tuple, tree: Tree) -> bool:
            if not steps:
                return isinstance(at, Iri) and at.value in tree.seeds and any(at.value.startswith(c.prefix) for c in self.data.of_class(tree.from_type))
            expected, prop = steps[-1]
            can = self._begin(prop)
            if can is None or not can <= wide(frozenset((expected,))):
                return False
            return any((fits or at != root) and leads(x, steps[:-1], tree) for x, fits in back(prop, at))

        types = space.types.get(root, frozenset())
        return isinstance(self.data, Mapping) and any(t.steps and t.root == root and leads(root, t.steps, t) for t in space.trees)

    def roots(self, plan: Plan, answers: bool = False) -> dict[str, Solutions]:
        """Root variable → what is reached in its place; a plan without trees reaches nothing.

        ``answers``: only roots that restrict answers to the whole pattern.
        """
        out: dict[str, Solutions] = {}
        for space in plan.spaces:
            for root in space.agp.roots():
                if not isinstance(root, Var) or answers and self._sure(space, root):
                    continue
                groups: dict[tuple, list[Tree]] = {}
                for t in space.trees:
                    if t.root == root:
                        groups.setdefault(t.cycles, []).append(t)
                found = [_renamed(self.reach(*g, types=space.types.get(root, frozenset())), {AT: root.name}) for g in groups.values()]
                if len(found) > 1:
                    found = [reduce(S.union, found).distinct()]
                out[root.name] = found[0] if found else S.nothing([root.name], self.spark)
        return out

    # Fragments

    def quads(self, plan: Plan, filters: list[A.Expr] | None = None) -> DataFrame:
        """(tp, s, p, o): patterns' triples reached top-down, then reduced bottom-up.

        Top-down, a node's set is what its parents' links lead to; bottom-up, a
        subject stays if all its patterns have an answer and, where a pattern
        leads on, its object stays as well.
        """
        roots = {v: self._saved(x) for v, x in self.roots(plan).items()}
        parts = [q for space in plan.spaces for q in self._space(space, roots, filters or [])]
        return reduce(DataFrame.unionByName, parts).distinct()

    def _saved(self, x: Solutions) -> Solutions:
        return Solutions(checkpoint(x.df), x.kinds) if x.kinds else x

    def _space(self, space: Space, roots: dict[str, Solutions], filters: list[A.Expr]) -> list[DataFrame]:
        """Each node's set is saved once on the way down and once on the way up, so no plan holds more than its own step."""
        from graphloom.plans.compiler import Compiler

        wire, names = space.agp.wire(), space.names
        compiler = Compiler(self.spark, self.data)
        reached: dict[Term, Solutions | None] = {}
        order: list[Term] = []
        tree: dict[Triple, Term] = {}

        def table(t: Triple) -> Solutions:
            """A pattern's answers, with the filters on its variables."""
            out = self.data.bgp((t,), self.spark)
            for f in filters:
                if A.free(f) <= set(out.kinds):
                    out = Solutions(out.df.filter(compiler.expressions(out.values()).test(f)), out.kinds)
            return out

        def within(out: Solutions, x: Term, known: Solutions | None) -> Solutions:
            return S.semi(out, known) if known is not None and isinstance(x, Var) and x.name in out.kinds else out

        rows = {t: table(t) for t in space.agp.patterns}

        def down(x: Term, known: Solutions | None) -> None:
            reached[x] = known
            order.append(x)
            for t, o in wire.get(x, []):
                if o in wire and wire[o] and o not in reached and isinstance(o, Var):
                    tree[t] = o
                    down(o, self._saved(_one(within(rows[t], x, known), o.name, o.name)))

        for root in space.agp.roots():
            if root not in reached:
                down(root, roots.get(root.name) if isinstance(root, Var) else None)
        for x in wire:
            if x not in reached and wire[x]:
                down(x, None)
        for x in reversed(order):
            own = [t for t, _ in wire.get(x, [])]
            for t in own:
                if t in tree:
                    rows[t] = within(rows[t], tree[t], reached[tree[t]])
            if not isinstance(x, Var):
                continue
            stands = [within(rows[t], x, reached[x]) for t in own]
            parent = x in tree.values()
            if len(own) == 1 and not parent:
                rows[own[0]] = stands[0]
                continue
            kept = self._saved(reduce(S.semi, [_one(r, x.name, x.name) for r in stands]))
            for t in own:
                rows[t] = within(rows[t], x, kept)
            reached[x] = kept
        out = []
        for t, s in rows.items():
            side = lambda x, s=s: V.as_term(s.col(x.name), s.kinds[x.name]) if isinstance(x, Var) else _const(x)
            p = side(t.p)["lex"] if isinstance(t.p, Var) else F.lit(t.p.value)
            out.append(s.df.select(F.lit(names[t]).alias("tp"), side(t.s).alias("s"), p.alias("p"), side(t.o).alias("o")))
        return out


def _renamed(x: Solutions, names: dict[str, str]) -> Solutions:
    kinds = {names.get(v, v): k for v, k in x.kinds.items()}
    return Solutions(x.df.select(*(x.col(v).alias(S.column(names.get(v, v))) for v in x.kinds)), kinds)


def _part(x: Solutions, *names: str) -> Solutions:
    return Solutions(x.df.select(*(x.col(v) for v in names)), {v: x.kinds[v] for v in names})


def _const(x: Iri | Literal):
    from graphloom.functions.terms import lit

    return lit(x)
