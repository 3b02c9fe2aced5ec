"""The entry point: a dataset, a vocabulary, and queries over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import solutions as S
from graphloom.operators.traversal import Traversal
from graphloom.operators.vocabulary import Vocabulary
from graphloom.plans import algebra as A
from graphloom.plans.agp import AGP, from_bgp
from graphloom.plans.compiler import Compiler, Hook
from graphloom.plans.parser import parse
from graphloom.plans.planner import Plan, Planner
from graphloom.sources.dereference import Loader, dereference
from graphloom.sources.fragments import FragmentCache, say
from graphloom.sources.mapping import Mapping
from graphloom.sources.store import checkpoint
from graphloom.sources.triples import SCHEMA, TripleStore


@dataclass
class Session:
    """``data``: mapped tables or a triple store; ``vocab``: ontologies and seeds."""

    spark: SparkSession
    data: Mapping | TripleStore
    vocab: Vocabulary = field(default_factory=Vocabulary)
    prefixes: dict[str, str] = field(default_factory=dict)
    functions: dict[str, Callable] = field(default_factory=dict)
    hooks: dict[str, Hook] = field(default_factory=dict)
    cache: FragmentCache | None = None
    loader: Loader | None = None  # for FROM and FROM NAMED: graphs that the store does not have
    decimals: bool = False  # whether results show decimals as such, not as doubles
    _memo: dict[tuple, DataFrame] = field(default_factory=dict)  # collected fragments

    @contextmanager
    def cancellable(self, tag: str):
        """Jobs started inside can be stopped by ``cancel(tag)`` from another thread."""
        self.spark.addTag(tag)
        try:
            yield self
        finally:
            self.spark.removeTag(tag)

    def cancel(self, tag: str) -> list[str]:
        return self.spark.interruptTag(tag)

    @property
    def planner(self) -> Planner:
        return Planner(self.vocab)

    def parse(self, text: str) -> A.Query:
        return parse(text, self.vocab.prefixes | self.prefixes)

    def sparql(self, text: str, scope: str = "dataset", seeds: dict[str, list[str]] | None = None, semantics: str = "standard", bindings: dict | None = None) -> DataFrame:
        """The answer as a DataFrame.

        ``scope="reachable"`` keeps only what is reached from the registered
        seeds, or from ``seeds`` (class → IRIs).  ``scope="fragment"`` first collects what the
        query's patterns reach from them, then answers over all that was collected as one graph, so that what one pattern
        reached can serve another.  ``bindings`` are variables with a value given beforehand.
        """
        q = self.parse(text)
        if bindings:
            given = A.Values(tuple(bindings), (tuple(bindings.values()),))
            q.part = _beneath(q.part, given)
        data = self.data
        if q.default_graphs or q.named_graphs:
            if self.loader:
                wanted = self.spark.createDataFrame([(u,) for u in {*q.default_graphs, *q.named_graphs}], "uri string")
                missing = wanted.join(data.df.select(F.col("g").alias("uri")).distinct(), "uri", "left_anti")
                data = TripleStore(data.df.unionByName(dereference(missing, self.loader)))
            data = data.with_graphs(q.default_graphs, q.named_graphs)
        if scope == "fragment":
            data = TripleStore(self._collected(q, seeds).withColumn("g", F.lit(None).cast("string")), disjoint=True)
        compiler = Compiler(self.spark, data, semantics, self.functions, self.hooks)
        compiler.decimals = self.decimals
        if scope == "reachable":
            compiler.hooks = {**compiler.hooks, "reachable": self._reachable(seeds)}
        elif scope not in ("dataset", "fragment"):
            raise ValueError(scope)
        return {"select": compiler.select, "ask": compiler.ask, "construct": compiler.construct}[q.form](q)

    def _collected(self, q: A.Query, seeds: dict[str, list[str]] | None) -> DataFrame:
        """(s, p, o): the fragments of all patterns of a query as one set; equal ones up to names are collected once a session."""
        parts, digest = [], self._digest(seeds)
        for bgp, filters in A.bgps(q.part):
            agp = from_bgp(bgp)
            text, names = agp.canonical()
            key = (text, tuple(sorted(say(f, {v.name: n for v, n in names.items()}) for f in filters)), digest, id(self.data))
            if key not in self._memo:
                quads = Traversal(self.spark, self.data, self.vocab).quads(self.planner.plan(agp, seeds), filters)
                self._memo[key] = checkpoint(quads.select("s", "p", "o").distinct())
            parts.append(self._memo[key])
        if not parts:
            return self.spark.createDataFrame([], SCHEMA).select("s", "p", "o")
        return reduce(DataFrame.unionByName, parts).distinct()

    def _digest(self, seeds: dict[str, list[str]] | None) -> str:
        return self.vocab.digest(sorted(self.vocab.seeds.types())) if seeds is None else repr(sorted((t, sorted(u)) for t, u in seeds.items()))

    def _reachable(self, seeds: dict[str, list[str]] | None) -> Hook:
        """Basic graph patterns are answered with their roots restricted to what seeds reach."""

        def hook(compiler: Compiler, n: A.Node):
            if isinstance(n, A.Path):
                raise NotImplementedError("closures in the reachable scope")
            if not isinstance(n, A.BGP) or not n.triples:
                return None
            plan = self.planner.plan(from_bgp(n), seeds)
            out = compiler.data.bgp(n.triples, self.spark)
            for reached in Traversal(self.spark, compiler.data, self.vocab).roots(plan, answers=True).values():
                out = S.semi(out, reached)
            return out

        return hook

    # Graph patterns, plans and fragments

    def agps(self, text: str) -> list[tuple[AGP, list[A.Expr]]]:
        """The query's graph patterns with the filters on single variables."""
        return [(from_bgp(b), f) for b, f in A.bgps(self.parse(text).part)]

    def search_plan(self, text: str, seeds: dict[str, list[str]] | None = None) -> list[Plan]:
        return [self.planner.plan(agp, seeds) for agp, _ in self.agps(text)]

    def fragment_quads(self, text: str, seeds: dict[str, list[str]] | None = None) -> DataFrame:
        """(tp, s, p, o): every triple that takes part in a match reached from the seeds, with its pattern."""
        # A kept fragment is stale when the seeds of any class have changed; seeds given here are a case of their own.
        digest = self._digest(seeds)
        parts = []
        for agp, filters in self.agps(text):
            make = lambda agp=agp, filters=filters: Traversal(self.spark, self.data, self.vocab).quads(self.planner.plan(agp, seeds), filters)
            parts.append(self.cache.get(agp, filters, make, digest, getattr(self.data, "ttl", None)) if self.cache else make())
        if not parts:
            raise ValueError("the query has no graph pattern")
        out = parts[0]
        for i, p in enumerate(parts[1:], 1):
            out = out.unionByName(p.withColumn("tp", _tagged(i)))
        return out

    def fragment(self, text: str, seeds: dict[str, list[str]] | None = None) -> DataFrame:
        """(s, p, o): the fragment as a graph."""
        return self.fragment_quads(text, seeds).select("s", "p", "o").distinct()

    def fragment_generator(self, text: str, seeds: dict[str, list[str]] | None = None) -> Iterator:
        """Quads one by one, without gathering them first."""
        return self.fragment_quads(text, seeds).toLocalIterator()


def _tagged(i: int) -> Column:
    return F.concat(F.lit(f"{i}."), F.col("tp"))


def _beneath(n: A.Node, given: A.Values) -> A.Node:
    """Join given bindings below the modifiers."""
    if isinstance(n, (A.Slice, A.Distinct, A.Reduced, A.Project, A.OrderBy)):
        return replace(n, part=_beneath(n.part, given))
    return A.Join(n, given)
