"""Paths, free predicates over tables, long chains, cycles that alternate."""

import itertools
import random

import pytest

from graphloom import tables
from graphloom.functions.terms import Iri
from graphloom.functions.values import Kind
from graphloom.operators import closure
from graphloom.operators.crawl import Crawl
from graphloom.operators.solutions import Solutions
from graphloom.operators.traversal import Traversal
from graphloom.operators.vocabulary import Vocabulary
from graphloom.plans.compiler import Compiler
from graphloom.plans.parser import parse
from graphloom.plans.planner import Tree
from graphloom.session import Session
from graphloom.sources.mapping import Mapping, TableClass, triples_of
from graphloom.sources.triples import TripleStore, frame

SF = "/root/testdata/sf0.001"
P = {"": "urn:e#"}


def edges():
    rng = random.Random(8)
    return {p: {(rng.randrange(9), rng.randrange(9)) for _ in range(9)} for p in "ab"} | {"f": {(i, (i * 2) % 9) for i in range(1, 8)}}


def store(spark):
    return TripleStore(frame(spark, [(Iri(f"urn:n#{x}"), Iri(f"urn:e#{p}"), Iri(f"urn:n#{y}")) for p, own in edges().items() for x, y in own]))


def walked(way, own, nodes):
    """Pairs of a path by plain sets."""
    if way in own:
        return own[way]
    op, *args = way
    parts = [walked(w, own, nodes) for w in args]
    if op == "^":
        return {(y, x) for x, y in parts[0]}
    if op == "|":
        return set().union(*parts)
    if op == "/":
        out = parts[0]
        for p in parts[1:]:
            out = {(x, z) for x, y in out for v, z in p if v == y}
        return out
    if op == "?":
        return parts[0] | {(x, x) for x in nodes}
    out = set(parts[0])
    while more := {(x, z) for x, y in out for v, z in parts[0] if v == y} - out:
        out |= more
    return out if op == "+" else out | {(x, x) for x in nodes}


@pytest.mark.parametrize(
    ("text", "way"),
    [("a+", ("+", "a")), ("(a/b)+", ("+", ("/", "a", "b"))), ("(a|^b)+", ("+", ("|", "a", ("^", "b")))), ("f+", ("+", "f")), ("^(a+)/b", ("/", ("^", ("+", "a")), "b"))],
)
def test_paths_equal_plain_sets(spark, text, way, monkeypatch):
    monkeypatch.setattr(closure, "PATIENCE", 2)
    said = text
    for p in "abf":
        said = said.replace(p, f":{p}")
    own = edges()
    nodes = {x for e in own.values() for pair in e for x in pair}
    want = walked(way, own, nodes)
    c = Compiler(spark, store(spark))
    run = lambda q: {tuple(int(x[6:]) for x in r) for r in c.select(parse(q, P)).collect()}
    assert run(f"SELECT DISTINCT ?x ?y {{ ?x {said} ?y }}") == want
    assert run(f"SELECT DISTINCT ?y {{ <urn:n#2> {said} ?y }}") == {(y,) for x, y in want if x == 2}
    assert run(f"SELECT DISTINCT ?x {{ ?x {said} <urn:n#4> }}") == {(x,) for x, y in want if y == 4}
    assert run(f"SELECT DISTINCT ?x {{ ?x {said} ?x }}") == {(x,) for x, y in want if x == y}


@pytest.mark.parametrize(("text", "way"), [(":a*", ("*", "a")), (":b?", ("?", "b")), ("(:a/:b)*", ("*", ("/", "a", "b")))])
def test_paths_of_no_step(spark, text, way):
    own = edges()
    nodes = {x for e in own.values() for pair in e for x in pair}
    want, starts = walked(way, own, nodes), {y for _, y in own["f"]}
    c = Compiler(spark, store(spark))
    got = {tuple(int(x[6:]) for x in r) for r in c.select(parse(f"SELECT DISTINCT ?x ?y {{ ?z :f ?x . ?x {text} ?y }}", P)).collect()}
    assert got == {(x, y) for x, y in want if x in starts}
    back = {tuple(int(x[6:]) for x in r) for r in c.select(parse(f"SELECT DISTINCT ?x ?y {{ ?z :f ?y . ?x {text} ?y }}", P)).collect()}
    assert back == {(x, y) for x, y in want if y in starts}
    assert [r.y for r in c.select(parse(f"SELECT ?y {{ <urn:none> {text} ?y }}", P)).collect()] == ["urn:none"]


def test_long_chains_take_few_rounds(spark):
    n = 20_000
    own = TableClass("urn:E", "e", "id", "urn:e/", {}, {"urn:next": ("id + 1", "urn:E")})
    t = Traversal(spark, Mapping({own.iri: own}, lambda _: spark.range(n)), Vocabulary())
    got = t.fixpoint(Solutions(spark.range(1).selectExpr("id as v_at"), {"at": Kind("iri", own.prefix, True, "bigint")}), ["urn:next"])
    assert got.df.count() == n + 1 and got.df.distinct().count() == n + 1 and len(t.rounds) <= 8 + 16


def test_closures_of_a_chain_double(spark):
    s = TripleStore(frame(spark, [(Iri(f"urn:n#{i}"), Iri("urn:e#p"), Iri(f"urn:n#{i + 1}")) for i in range(60)]))
    rows = Compiler(spark, s).select(parse("SELECT ?y { <urn:n#0> :p+ ?y }", P)).collect()
    assert sorted(int(r.y[6:]) for r in rows) == list(range(1, 61))


def chain():
    """Seven resources linked by a, b, a, b, ..."""
    return {f"urn:n#{i}": f"<urn:n#{i}> <urn:e#{'ab'[i % 2]}> <urn:n#{i + 1}> ." for i in range(6)} | {"urn:n#6": '<urn:n#6> <urn:e#x> "end" .'}


class Chain:
    def __call__(self, uri, format_):
        return (chain()[uri], {}) if format_ == "turtle" and uri in chain() else False


TREE = Tree("urn:T", ("urn:n#0",), (), Iri("urn:r"), ((("urn:T", "urn:e#a"),), (("urn:T", "urn:e#b"),)), 1)


def test_crawl_follows_cycles_that_alternate(spark):
    found = Crawl(spark, Vocabulary(), Chain())._reach(TREE)
    assert sorted(r.uri for r in found.collect()) == [f"urn:n#{i}" for i in range(7)]


def test_traversal_follows_cycles_that_alternate(spark):
    rows = [(Iri(f"urn:n#{i}"), Iri(f"urn:e#{'ab'[i % 2]}"), Iri(f"urn:n#{i + 1}")) for i in range(6)]
    got = Traversal(spark, TripleStore(frame(spark, rows)), Vocabulary()).reach(TREE)
    assert sorted(r[0].lex for r in got.df.collect()) == [f"urn:n#{i}" for i in range(7)]


@pytest.mark.parametrize(
    "query",
    ["{ ?s ?p <urn:data:nation/3> }", '{ ?s ?p "BUILDING" }', "{ <urn:data:customer/7> ?p ?o }", "{ ?s a t:Supplier . ?s ?p ?o }", "{ ?s ?p 5 }", "{ ?s ?p t:Region }", "{ <urn:none> ?p ?o }", "{ ?s ?p ?o . ?o t:r_name 'ASIA' }", "{ ?s ?p ?p }"],
)
def test_free_predicates_equal_those_of_triples(spark, query):
    of = tables.mapping(spark, SF)
    some = {iri: c for iri, c in of.classes.items() if c.table in ("region", "nation", "customer", "supplier")}
    small = Mapping(some, of.read, {}, {})
    ask = f"SELECT * WHERE {query}"
    mapped = Session(spark, small, prefixes=dict(tables.PREFIXES)).sparql(ask)
    plain = Session(spark, TripleStore(triples_of(small)), prefixes=dict(tables.PREFIXES)).sparql(ask)
    cols = sorted(plain.columns)
    key = lambda df: sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    assert sorted(mapped.columns) == cols and key(mapped) == key(plain)


def test_free_predicates_skip_rows_and_classes(spark):
    plan = tables.session(spark, SF).sparql("SELECT ?s ?p WHERE { ?s ?p <urn:data:nation/3> }")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("EqualTo(c_nationkey,3)") + plan.count("EqualTo(s_nationkey,3)") == 2 and "c_name" not in plan


def test_cycles_that_branch_are_not_doubled(spark):
    rows = [(Iri(f"urn:n#{i}"), Iri("urn:e#a"), Iri(f"urn:n#{j}")) for i in range(12) for j in (i + 1, max(0, i - 1))]
    t = Traversal(spark, TripleStore(frame(spark, rows)), Vocabulary())
    got = t.reach(Tree("urn:T", ("urn:n#0",), (), Iri("urn:r"), ((("urn:T", "urn:e#a"),),), 1))
    assert got.df.count() == 13 and len(t.rounds) == 13
