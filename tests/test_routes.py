"""Traversal by places: rows that are resources of their own are passed without keys, and nothing goes on twice from a place."""

import random

import pytest

from graphloom import linked_queries, queries
from graphloom import tables as mapped
from graphloom.functions.terms import Iri
from graphloom.operators import traversal
from graphloom.operators.traversal import Traversal
from graphloom.operators.vocabulary import Vocabulary
from graphloom.plans.planner import Tree
from graphloom.sources import store
from graphloom.sources.mapping import Mapping, TableClass

SF = "/root/testdata/sf0.001"
INVERSES = {"ofB": "toB", "ofC": "toC", "hasRow": "rx", "byRow": "ry"}
CYCLES = [["toB", "toC", "ofC", "ofB"], ["hasRow", "ry", "ofB"], ["toB", "byRow", "rx"], ["hasRow", "rx"]]
TREES = [("C", 0, [("C", "ofC"), ("B", "ofB")]), ("C", 1, [("C", "ofC"), ("A", "ofB")]), ("B", 2, [("B", "byRow"), ("R", "rx")]), ("B", 3, [("B", "byRow"), ("A", "rx")])]


def tables(seed, n):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, *range(n)])
    return {"a": [(i, pick()) for i in range(2 * n)], "b": [(i, pick()) for i in range(n)], "r": [(rng.choice([None, *range(2 * n)]), pick()) for _ in range(n // 2)]}


def walked(own, cycles):
    """Keys of A by plain sets."""
    rows = [(i, x, y) for i, (x, y) in enumerate(own["r"])]
    links = {"toB": [(("A", a), ("B", b)) for a, b in own["a"] if b is not None], "toC": [(("B", b), ("C", c)) for b, c in own["b"] if c is not None]}
    links |= {"rx": [(("R", i), ("A", x)) for i, x, _ in rows if x is not None], "ry": [(("R", i), ("B", y)) for i, _, y in rows if y is not None]}
    links |= {q: [(y, x) for x, y in links[p]] for q, p in INVERSES.items()}
    step = lambda at, p: {y for x, y in links[p] if x in at}
    found = set()
    for start, key, steps in TREES:
        at = {(start, key)}
        for expected, p in steps:
            at = step({x for x in at if x[0] == expected}, p)
        found |= at
    new = found
    while new:
        ends = set()
        for props in cycles:
            at = new
            for p in props:
                at = step(at, p)
            ends |= at
        new = ends - found
        found |= new
    return sorted(k for _, k in found)


@pytest.mark.parametrize(("seed", "light"), [(1, 0), (2, 16_000_000), (3, 300)])
def test_places_equal_plain_sets(spark, seed, light, monkeypatch):
    monkeypatch.setattr(traversal, "LIGHT_BYTES", light)
    own = tables(seed, 30)
    frames = {t: spark.createDataFrame(rows, s) for (t, rows), s in zip(own.items(), ("a long, b long", "b long, c long", "x long, y long"), strict=True)}
    classes = [TableClass("A", "a", "a", "urn:a/", {}, {"toB": ("b", "B")}), TableClass("B", "b", "b", "urn:b/", {}, {"toC": ("c", "C")}), TableClass("C", "b", "c", "urn:c/", {"c": "c"}, {})]
    classes.append(TableClass("R", "r", "md5(concat_ws('|', coalesce(x, -1), coalesce(y, -1)))", "urn:r/", {}, {"rx": ("x", "A"), "ry": ("y", "B")}, True))
    data = Mapping({c.iri: c for c in classes}, frames.__getitem__, INVERSES)
    for cycles in ([], CYCLES[:2], CYCLES):
        turns = tuple(tuple(("", p) for p in c) for c in cycles)
        trees = [Tree(c, (f"urn:{c.lower()}/{k}",), tuple(steps), Iri("urn:root"), turns, 1) for c, k, steps in TREES]
        got = Traversal(spark, data, Vocabulary()).reach(*trees)
        assert sorted(r[0] for r in got.df.collect()) == walked(own, cycles)


def test_rows_are_passed_without_their_keys(spark, monkeypatch):
    plans = []

    def saved(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store.checkpoint(df)

    monkeypatch.setattr(traversal, "checkpoint", saved)
    assert linked_queries.reach_orders(spark, SF).count() and plans
    assert not [p for p in plans if "md5" in p]


def region(spark, ask):
    return mapped.session(spark, SF, {"Region": ["urn:data:region/2"]}).sparql(ask, scope="reachable")


def test_answers_tied_to_a_seed_need_no_traversal(spark, monkeypatch):
    monkeypatch.setattr(traversal, "checkpoint", lambda df: pytest.fail("nothing is to be traversed"))
    tied = queries.reach_seed_region(spark, SF)
    monkeypatch.undo()
    with monkeypatch.context() as m:
        m.setattr(Traversal, "_sure", lambda *_: False)
        assert sorted(queries.reach_seed_region(spark, SF).collect()) == sorted(tied.collect()) != []


@pytest.mark.parametrize("ask", ["{ ?c t:c_custkey ?k ; t:inNation ?n . ?n t:inRegion <urn:data:region/1> }", "{ ?c t:c_custkey ?k ; t:inNation ?n . ?n t:inRegion ?r }"])
def test_answers_not_tied_to_a_seed_are_traversed(spark, ask, monkeypatch):
    found = []
    sure = Traversal._sure
    monkeypatch.setattr(Traversal, "_sure", lambda *a: found.append(sure(*a)) or found[-1])
    region(spark, f"SELECT ?k WHERE {ask}")
    assert found == [False]
