"""Answers over what was collected, expected classes on the way, joins of rows that bind different variables."""

import itertools
import random

import pytest

from graphloom import tables
from graphloom.operators import solutions as S
from graphloom.operators.traversal import Traversal
from graphloom.plans.agp import AGP, parse_agp
from graphloom.functions.terms import Var
from graphloom.plans.algebra import Triple

SF = "/root/testdata/sf0.001"
P = {"": "urn:e#"}


@pytest.mark.parametrize(
    "text", ["?a :p ?b . ?b :q ?c . ?c :p ?a", "?a :p ?b . ?c :p ?d . ?a :q ?d", "?a :p ?b . ?b :p ?c . ?c :p ?d . ?d :p ?a", "?a :p ?a . ?a :q 'x' . ?b :q 'x'", "?x :p <urn:c> . ?y :p <urn:c> . ?z :p ?x"]
)
def test_canonical_form_is_one_for_all_names_and_orders(text):
    agp = parse_agp(text, P)
    names = sorted({x.name for t in agp.patterns for x in t if isinstance(x, Var)})
    rng, seen = random.Random(1), set()
    for _ in range(12):
        to = dict(zip(names, rng.sample(["m", "n", "o", "k", "l"], len(names)), strict=True))
        moved = [Triple(*(Var(to[x.name]) if isinstance(x, Var) else x for x in t)) for t in agp.patterns]
        rng.shuffle(moved)
        seen.add(AGP(tuple(moved)).canonical()[0])
    assert len(seen) == 1
    others = [parse_agp(t, P).canonical()[0] for t in ("?a :p ?b . ?b :q ?c . ?c :q ?a", "?a :p ?b . ?c :p ?d . ?a :q ?c", "?a :p ?b . ?b :p ?c . ?c :p ?d . ?a :p ?d")]
    assert not seen & set(others)


def test_fragment_scope_answers_what_another_pattern_collected(spark):
    s = tables.session(spark, SF, {"Label": ["urn:data:labels/1"]})
    ask = """SELECT ?x ?w WHERE { { <urn:data:region/2> t:hasNation ?n . ?n t:n_name ?x BIND("own" AS ?w) } UNION { ?m t:n_name ?x BIND("collected" AS ?w) } }"""
    both = s.sparql(ask, scope="fragment").collect()
    roots = s.sparql(ask, scope="reachable").collect()
    assert {r.w for r in roots} == {"own"} and {r.w for r in both} == {"own", "collected"} and len(both) == 2 * len(roots)
    held = len(s._memo)
    renamed = ask.replace("?n", "?k").replace("?x ?w", "?x").replace("?m", "?z")
    assert len(s.sparql(renamed, scope="fragment").collect()) == len(both) and len(s._memo) == held


def test_only_expected_classes_are_followed(spark):
    s = tables.session(spark, SF, {"Region": ["urn:data:region/2"]})
    space = s.search_plan("SELECT * WHERE { ?c t:inNation ?n ; t:c_acctbal ?b }")[0].spaces[0]
    tree = next(t for t in space.trees if len(t.steps) == 2)
    t = Traversal(spark, s.data, s.vocab)
    typed = t.gate(t.follow(t.follow(t.seeds(tree), tree.steps[0][1]), tree.steps[1][1]), space.types[tree.root])
    every = t.follow(t.follow(t.seeds(tree), tree.steps[0][1]), tree.steps[1][1])
    kinds = lambda x: {r[0].split("/")[0] for r in x.df.collect()}
    assert kinds(typed) == {"urn:data:customer"} and kinds(every) == {"urn:data:customer", "urn:data:supplier"}


def table(spark, rows, names):
    from graphloom.functions.values import Kind

    df = spark.createDataFrame(rows, ", ".join(f"{S.column(n)} long" for n in names))
    return S.Solutions(df, {n: Kind("int", certain=all(r[i] is not None for r in rows)) for i, n in enumerate(names)})


@pytest.mark.parametrize("seed", range(4))
def test_joins_by_masks_equal_compatible_pairs(spark, seed):
    rng = random.Random(seed)
    row = lambda n: tuple(rng.choice((None, 1, 2)) for _ in range(n))
    a, b = [row(4) for _ in range(30)], [row(4) for _ in range(30)]
    if seed == 3:
        b = [tuple(x or 1 for x in r) for r in b]
    want = []
    for x, y in itertools.product(a, b):
        own, other = dict(zip("pqrs", x, strict=True)), dict(zip("qrst", y, strict=True))
        if all(own[v] is None or other[v] is None or own[v] == other[v] for v in "qrs"):
            want.append(tuple((own.get(v) if own.get(v) is not None else other.get(v)) for v in "pqrst"))
    got = S.join(table(spark, a, "pqrs"), table(spark, b, "qrst"))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r[S.column(v)] for v in "pqrst") for r in got.df.collect()), key=key) == sorted(want, key=key)


def test_a_join_by_masks_reads_each_side_once(spark):
    s = tables.session(spark, SF)
    ask = "SELECT * WHERE { { ?c t:c_custkey ?k OPTIONAL { ?c t:c_name ?n FILTER(?k < 50) } } { ?d t:c_acctbal ?b OPTIONAL { ?d t:c_name ?n FILTER(?b < 0) } } }"
    plan = s.sparql(ask)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4


def test_a_hot_group_is_joined_in_parts(spark):
    from pyspark.sql import functions as F

    from graphloom.functions.values import Kind
    from graphloom.plans.algebra import Agg, Group, Ref, Values
    from graphloom.plans.compiler import Compiler

    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("v_g"), F.concat(F.lit("x"), F.col("id") % 1999).alias("v_t"))
    given = S.Solutions(df, {"g": Kind("str").maybe(), "t": Kind("str")})
    c = Compiler(spark, None, hooks={"given": lambda c, n: given if isinstance(n, Values) else None})
    aggs = (("n", Agg("COUNT", None)), ("all", Agg("GROUP_CONCAT", Ref("t"), False, "|")), ("each", Agg("GROUP_CONCAT", Ref("t"), True, ",")))
    out = c.compile(Group(Values((), ()), (("g", Ref("g")),), aggs))
    rows = df.collect()
    want = {}
    for r in rows:
        want.setdefault(r.v_g, []).append(r.v_t)
    got = {r.v_g: r for r in out.df.collect()}
    assert set(got) == set(want)
    for g, own in want.items():
        assert (got[g].v_n, got[g].v_all, got[g].v_each) == (len(own), "|".join(sorted(own)), ",".join(sorted(set(own))))


def test_fact_tables_equal_the_facts_of_a_vocabulary(spark):
    from graphloom.operators.facts import FactTables
    from graphloom.operators.paths import Navigator
    from graphloom.operators.vocabulary import Vocabulary, read_ontology
    from graphloom.sources.triples import frame

    text = tables.ontology()
    v = Vocabulary()
    v.add(text)
    f, nav = v.facts, Navigator(v)
    t = FactTables(spark, frame(spark, list(read_ontology(text)[0])))
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(t.types) == {(x,) for x in f.types()}
    assert rows(t.properties) == {(p, "object" if f.is_object(p) else "data") for p in f.properties()}
    assert rows(t.closure) == {(c, s) for c in f.types() for s in f.supertypes(c)}
    assert rows(t.inverses) == {(p, q) for p in f.properties() for q in f.inverses(p)}
    assert rows(t.domains()) == {(p, c) for p in f.properties() for c in f.domain(p)}
    assert rows(t.ranges()) >= {(p, c) for p in f.properties() if f.is_object(p) for c in f.range(p)}
    assert rows(t.members()) == {(c, p, "own" if p in f.type_properties(c, True) else "inherited") for c in f.types() for p in f.type_properties(c)}
    assert rows(t.references()) == {(c, p, "own" if p in f.type_references(c, True) else "inherited") for c in f.types() for p in f.type_references(c)}
    assert rows(t.edges()) == {(c, p, r) for c, own in nav.edges.items() for p, r in own}
    some = sorted(f.types())[:6]
    linked = rows(t.connected())
    assert all(((a, b) in linked) == nav.connected(a, b) for a, b in itertools.product(some, some))
