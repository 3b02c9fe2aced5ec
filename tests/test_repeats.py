"""Path pairs that stand often are counted, and repeated at the end in many tasks."""

import collections

import pytest

from graphloom.functions.terms import Iri
from graphloom.operators import solutions as S
from graphloom.operators.closure import N, Paths
from graphloom.plans.compiler import Compiler
from graphloom.plans.parser import parse
from graphloom.sources.triples import TripleStore, frame

P = {"": "urn:e#"}
HUB = [(f"m{i}", "in", "hub") for i in range(40)] + [("m0", "in", "side"), ("hub", "up", "top"), ("s1", "at", "hub"), ("s2", "at", "hub"), ("s2", "at", "side")]


def hub(spark):
    return TripleStore(frame(spark, [(Iri(f"urn:n#{s}"), Iri(f"urn:e#{p}"), Iri(f"urn:n#{o}")) for s, p, o in HUB]))


def of(p):
    return [(s, o) for s, q, o in HUB if q == p]


def way(text):
    """Pairs of a path with their multiplicities, by plain lists."""
    members = [(x, y) for m, x in of("in") for k, y in of("in") if m == k]
    two = [(x, z) for x, y in members for v, z in members if v == y]
    up = of("up") + [(x, x) for x in {y for _, y in of("at")}]
    return collections.Counter((s, z) for s, x in of("at") for v, z in {"members": members, "two": two, "either": members + up}[text] if v == x)


@pytest.mark.parametrize(("text", "name"), [(":at/(^:in/:in)", "members"), (":at/(^:in/:in)/(^:in/:in)", "two"), (":at/(:up?|^:in/:in)", "either")])
def test_sequences_keep_multiplicities(spark, text, name, monkeypatch):
    monkeypatch.setattr(S, "MOST_REPEATS", 7)
    c = Compiler(spark, hub(spark))
    rows = lambda q: collections.Counter(tuple(x.removeprefix("urn:n#") for x in r) for r in c.select(parse(q, P)).collect())
    want = way(name)
    assert rows(f"SELECT ?x ?y {{ ?x :at ?z . ?x {text} ?y }}") == collections.Counter({p: n * len([1 for s, _ in of("at") if s == p[0]]) for p, n in want.items()})
    assert rows(f"SELECT ?y {{ <urn:n#s2> {text} ?y }}") == collections.Counter({(y,): n for (x, y), n in want.items() if x == "s2"})
    assert rows(f"SELECT ?x {{ ?x {text} <urn:n#side> }}") == collections.Counter({(x,): n for (x, y), n in want.items() if y == "side"})


def test_pairs_by_a_hub_are_counted(spark):
    at, inside = ("p", Iri("urn:e#at")), ("p", Iri("urn:e#in"))
    found = Paths(spark, hub(spark)).pairs(("/", at, ("/", ("^", inside), inside)))
    rows = found.df.select(found.col("at")["lex"], found.col("to")["lex"], found.col(N)).collect()
    assert collections.Counter({(a.removeprefix("urn:n#"), b.removeprefix("urn:n#")): n for a, b, n in rows}) == way("members") and len(rows) == len(way("members"))


def test_one_pair_is_repeated_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_REPEATS", 100)
    x = S.Solutions(spark.sql("SELECT 'a' AS v_x, 100000L AS `v_*n` UNION ALL SELECT 'b', 1L"), {"x": S.Kind("str"), N: S.Kind("int")})
    each = S.repeated(x, N).df.selectExpr("v_x", "spark_partition_id() AS p").groupBy("v_x", "p").count().collect()
    assert sum(r["count"] for r in each if r.v_x == "a") == 100_000 and sum(r["count"] for r in each if r.v_x == "b") == 1
    assert len({r.p for r in each}) == 4 and max(r["count"] for r in each) < 40_000
