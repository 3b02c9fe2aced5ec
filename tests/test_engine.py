import collections

import pytest

from graphloom import tables
from graphloom.functions.terms import Iri, Literal, Var
from graphloom.operators.paths import Navigator
from graphloom.operators.vocabulary import Duplicate, NotFound, Vocabulary, VocabularyError
from graphloom.plans.agp import parse_agp
from graphloom.plans.planner import Planner
from graphloom.session import Session
from graphloom.sources.fragments import FragmentCache, FragmentStream, ResourceCache, ttl_of
from graphloom.sources.results import json_lines
from graphloom.sources.triples import TripleStore, frame
from graphloom.sources.turtle import deskolemise, parse_turtle, read_turtle, skolemise, write_turtle
from graphloom.streaming.incremental import IncrementalPattern
from graphloom.tables import NS

HEAD = "@prefix e: <urn:e#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
SENSORS = HEAD + """
<urn:e> a owl:Ontology .
e:Container a owl:Class . e:Observation a owl:Class . e:Component a owl:Class . e:Value a owl:Class .
e:Hot rdfs:subClassOf e:Observation , [ a owl:Restriction ; owl:onProperty e:monitors ; owl:allValuesFrom e:Fire ] . e:Fire rdfs:subClassOf e:Component .
e:contains a owl:ObjectProperty ; rdfs:domain e:Container ; rdfs:range e:Observation .
e:monitors a owl:ObjectProperty ; rdfs:domain e:Observation ; rdfs:range e:Component .
e:hasValue a owl:ObjectProperty ; rdfs:domain e:Observation ; rdfs:range e:Value .
e:label a owl:DatatypeProperty ; rdfs:domain e:Component . e:literalValue a owl:DatatypeProperty ; rdfs:domain e:Value . e:timeStamp a owl:DatatypeProperty ; rdfs:domain e:Value .
e:within a owl:ObjectProperty ; owl:inverseOf e:contains .
e:Extra rdfs:subClassOf [ owl:onProperty e:size ; owl:onDataRange <http://www.w3.org/2001/XMLSchema#int> ] , [ owl:onProperty e:likes ; owl:someValuesFrom e:Value ] .
"""


def sensors():
    v = Vocabulary()
    assert v.add(SENSORS) == "e"
    return v


def e(*names):
    return {f"urn:e#{n}" for n in names}


def test_facts():
    f = sensors().facts
    assert f.types() == e("Container", "Observation", "Component", "Value", "Hot", "Fire", "Extra")
    assert f.properties() == e("contains", "monitors", "hasValue", "label", "literalValue", "timeStamp", "within", "size", "likes")
    assert f.subtypes("urn:e#Observation") == e("Hot") and f.supertypes("urn:e#Fire") == e("Component")
    assert f.domain("urn:e#monitors") == e("Observation", "Hot") and f.range("urn:e#monitors") == e("Component", "Fire")
    assert f.inverses("urn:e#contains") == e("within") and f.domain("urn:e#within") == e("Observation", "Hot")
    assert f.constraints("urn:e#monitors") == {"urn:e#Hot": e("Fire")}
    assert f.is_object("urn:e#likes") and not f.is_object("urn:e#size") and not f.is_object("urn:e#label")
    t = f.type("urn:e#Hot")
    assert set(t["spec_properties"]) == e("monitors") and set(t["properties"]) == e("monitors", "hasValue", "within") and set(t["refs"]) == e("contains")
    with pytest.raises(NotFound):
        f.type("urn:e#None")
    with pytest.raises(NotFound):
        f.property("urn:e#none")
    assert f.property("urn:e#contains")["type"] == "object"


def test_vocabularies_and_seeds():
    v = sensors()
    with pytest.raises(Duplicate):
        v.add(SENSORS)
    with pytest.raises(VocabularyError):
        v.add(HEAD + "e:A a owl:Class .")
    key = v.seeds.add("urn:s:1", "urn:e#Hot")
    with pytest.raises(Duplicate):
        v.seeds.add("urn:s:1", "urn:e#Hot")
    with pytest.raises(NotFound):
        v.seeds.add("urn:s:1", "urn:e#None")
    with pytest.raises(VocabularyError):
        v.seeds.add("no iri", "urn:e#Hot")
    assert v.seeds.get(key) == ("urn:e#Hot", "urn:s:1") and v.seeds.of_type("urn:e#Observation") == ["urn:s:1"]
    before = v.seeds.digest("urn:e#Observation")
    v.seeds.add("urn:s:2", "urn:e#Observation")
    assert v.seeds.digest("urn:e#Observation") != before
    v.seeds.delete(key)
    with pytest.raises(NotFound):
        v.seeds.get(key)
    again, _ = parse_turtle(v.get("e"))
    assert len(again) == len(v.graphs["e"])
    v.update("e", SENSORS.replace("e:Observation a owl:Class .", "").replace("e:Observation", "e:Other"))
    assert v.seeds.all() == []
    v.delete("e")
    assert v.list() == [] and v.facts.types() == set()
    with pytest.raises(NotFound):
        v.delete("e")


def test_imports_are_read_once_and_may_fail():
    one = HEAD + "<urn:one#> a owl:Ontology ; owl:imports <urn:two#> , <urn:three#> . e:A a owl:Class ."
    two = HEAD + "<urn:two#> a owl:Ontology ; owl:imports <urn:one#> . e:B rdfs:subClassOf e:A ."
    v = Vocabulary()
    v.add(one, {"urn:two#": two}.__getitem__)
    assert len(v.graphs) == 2 and v.facts.subtypes("urn:e#A") == e("B")


def test_navigation():
    v = sensors()
    v.seeds.add("urn:s:1", "urn:e#Container")
    nav = Navigator(v)
    assert [(p.steps, p.seeds) for p in nav.paths("urn:e#Value")][:1] == [((("urn:e#Container", "urn:e#contains"), ("urn:e#Observation", "urn:e#hasValue")), ("urn:s:1",))]
    assert nav.connected("urn:e#Container", "urn:e#Fire") and not nav.connected("urn:e#Value", "urn:e#Container")
    assert not nav.allowed("urn:e#Hot", "urn:e#monitors", "urn:e#Component") and nav.allowed("urn:e#Hot", "urn:e#monitors", "urn:e#Fire")
    assert (("urn:e#Container", "urn:e#contains"), ("urn:e#Observation", "urn:e#within")) in nav.cycles()
    assert nav.paths("urn:e#Container")[0].steps == ()


def test_plan_of_the_worked_example():
    """One tree from the container, thirteen steps over five patterns."""
    v = Vocabulary()
    v.add(SENSORS.replace("e:within a owl:ObjectProperty ; owl:inverseOf e:contains .", ""))
    v.seeds.add("urn:s:1", "urn:e#Container")
    agp = parse_agp("?s e:monitors ?c . ?c e:label ?comp . ?s e:hasValue ?v . ?v e:literalValue ?lv . ?v e:timeStamp ?t", {"e": "urn:e#"})
    assert agp.roots() == [Var("s")]
    plan = Planner(v).plan(agp)
    (tree,) = plan.spaces[0].trees
    assert (tree.from_type, tree.seeds, tree.steps, tree.length) == ("urn:e#Container", ("urn:s:1",), (("urn:e#Container", "urn:e#contains"),), 13)
    text = plan.turtle()
    triples, _ = parse_turtle(text)
    kinds = collections.Counter(o.value.split("#")[1] for s, p, o in triples if p.value.endswith("type"))
    assert kinds == {"SearchTree": 1, "SearchSpace": 1, "TriplePattern": 5, "Variable": 6}


def test_plans_that_cannot_be():
    v = sensors()
    v.seeds.add("urn:s:1", "urn:e#Container")
    p = {"e": "urn:e#"}
    assert Planner(v).plan(parse_agp("?s e:none ?o", p)).empty
    assert Planner(v).plan(parse_agp("?s e:contains ?o . ?s e:monitors ?c", p)).empty
    two = Planner(v).plan(parse_agp("?s e:contains ?o . ?x e:label ?y", p))
    assert len(two.spaces) == 2
    forced = Planner(v).plan(parse_agp("?s e:monitors ?c", p), {"urn:e#Observation": ["urn:s:9"]})
    assert forced.spaces[0].trees[0].seeds == ("urn:s:9",) and forced.spaces[0].trees[0].steps == ()


def test_agp_algebra():
    p = {"e": "urn:e#"}
    a = parse_agp("?a e:p ?b . ?b e:q 'x'", p)
    b = parse_agp("?y e:q 'x' . ?x e:p ?y", p)
    assert a.mapping(b) == {Var("a"): Var("x"), Var("b"): Var("y")}
    assert a.mapping(parse_agp("?y e:q 'z' . ?x e:p ?y", p)) is None
    assert a.mapping(parse_agp("?x e:p ?x . ?x e:q 'x'", p)) is None
    general, given = a.general()
    assert list(given.values()) == [Literal("x")] and len(general.patterns) == 2
    assert parse_agp("?a e:p ?b . ?b e:p ?a . ?b e:q ?c", p).roots() == [Var("a"), Var("b")]
    with pytest.raises(ValueError):
        parse_agp("?a e:p ?b OPTIONAL { ?b e:p ?c }", p)


DATA = HEAD + """
<urn:d:c1> a e:Container ; e:contains <urn:d:o1> , <urn:d:o2> . <urn:d:c2> a e:Container ; e:contains <urn:d:o3> .
<urn:d:o1> e:monitors <urn:d:k1> ; e:hasValue <urn:d:v1> . <urn:d:o2> e:hasValue <urn:d:v2> . <urn:d:o3> e:monitors <urn:d:k1> ; e:hasValue <urn:d:v3> .
<urn:d:k1> e:label "CO2" . <urn:d:v1> e:literalValue 5 . <urn:d:v2> e:literalValue 6 . <urn:d:v3> e:literalValue 7 .
"""


def sensor_session(spark, cache=None):
    v = sensors()
    v.seeds.add("urn:d:c1", "urn:e#Container")
    return Session(spark, TripleStore(frame(spark, parse_turtle(DATA)[0])), v, {"e": "urn:e#"}, cache=cache)


QUERY = "SELECT ?l ?n WHERE { ?s e:monitors ?c ; e:hasValue ?v . ?c e:label ?l . ?v e:literalValue ?n }"


def test_reachable_is_part_of_dataset(spark):
    s = sensor_session(spark)
    assert sorted(r.n for r in s.sparql(QUERY).collect()) == ["5", "7"]
    assert [r.n for r in s.sparql(QUERY, scope="reachable").collect()] == ["5"]
    assert [r.n for r in s.sparql(QUERY, scope="reachable", seeds={"urn:e#Observation": ["urn:d:o3"]}).collect()] == ["7"]


def test_fragment_is_reduced_and_enough(spark):
    s = sensor_session(spark)
    quads = s.fragment_quads(QUERY).collect()
    # The reduction is bottom-up: o2 goes for want of a component, its value was reached and stays.
    assert {(q.s.lex, q.o.lex) for q in quads} == {("urn:d:o1", "urn:d:k1"), ("urn:d:o1", "urn:d:v1"), ("urn:d:k1", "CO2"), ("urn:d:v1", "5"), ("urn:d:v2", "6")}
    whole = {(x.s.lex, x.p, x.o.lex) for x in s.data.df.collect()}
    assert {(q.s.lex, q.p, q.o.lex) for q in quads} <= whole
    again = Session(spark, TripleStore(s.fragment(QUERY).selectExpr("cast(null as string) g", "s", "p", "o")), s.vocab, s.prefixes)
    assert again.sparql(QUERY).collect() == s.sparql(QUERY, scope="reachable").collect()
    assert len(list(s.fragment_generator(QUERY))) == 5


def test_fragment_filters(spark):
    s = sensor_session(spark)
    quads = s.fragment_quads("SELECT * WHERE { ?s e:hasValue ?v . ?v e:literalValue ?n FILTER(?n > 5) FILTER(?n < 9) }").collect()
    assert {q.o.lex for q in quads} == {"urn:d:v2", "6"}


def test_fragment_cache(spark, tmp_path):
    now = [1000.0]
    cache = FragmentCache(spark, f"file://{tmp_path}/f", ttl=50, clock=lambda: now[0])
    s = sensor_session(spark, cache)
    first = s.fragment_quads("SELECT * WHERE { ?s e:hasValue ?v . ?v e:literalValue ?n }")
    assert cache.hits == 0 and first.count() == 4
    renamed = s.fragment_quads("SELECT * WHERE { ?b e:literalValue ?c . ?a e:hasValue ?b }")
    assert cache.hits == 1 and {r.tp for r in renamed.collect() if r.p.endswith("hasValue")} == {"tp_1"}
    special = s.fragment_quads("SELECT * WHERE { <urn:d:o1> e:hasValue ?b . ?b e:literalValue ?c }")
    assert cache.hits == 2 and {r.o.lex for r in special.collect()} == {"urn:d:v1", "5"}
    filtered = s.fragment_quads("SELECT * WHERE { ?s e:hasValue ?v . ?v e:literalValue ?n FILTER(?n > 5) }")
    assert cache.hits == 3 and {r.o.lex for r in filtered.collect()} == {"urn:d:v2", "6"}
    s.vocab.seeds.add("urn:d:c2", "urn:e#Container")
    assert s.fragment_quads("SELECT * WHERE { ?s e:hasValue ?v . ?v e:literalValue ?n }").count() == 6 and cache.hits == 3
    now[0] += 51
    assert cache.purge() == 2 and cache.catalog() == []


def test_fragment_stream_and_incremental_answers(spark, tmp_path):
    s = sensor_session(spark)
    quads = s.data.df.selectExpr("'tp_0' tp", "s", "p", "o")
    stream = FragmentStream(spark, f"file://{tmp_path}/s")
    half = quads.filter("crc32(concat(s.lex, p)) % 2 = 0")
    assert stream.put(half, 10) == half.count()
    assert stream.put(quads, 20) == quads.count() - half.count() and stream.put(quads, 30) == 0
    assert stream.get(10).count() == half.count() and stream.get().count() == quads.count()
    agp = parse_agp("?s e:hasValue ?v . ?v e:literalValue ?n . ?s e:monitors ?c", {"e": "urn:e#"})
    live = IncrementalPattern(spark, agp, f"file://{tmp_path}/i")
    assert live.answers().count() == 0
    live.start(stream.tail().select("tp", "s", "p", "o"), f"{tmp_path}/c").awaitTermination()
    want = s.sparql("SELECT ?c ?n ?s ?v WHERE { ?s e:hasValue ?v . ?v e:literalValue ?n . ?s e:monitors ?c }")
    assert sorted(live.answers().collect()) == sorted(want.collect())
    live.feed(quads, 99)
    assert live.answers().count() == 2


def test_incremental_cycle_makes_each_answer_once(spark, tmp_path):
    edges = [(1, 2), (2, 3), (3, 1), (2, 1), (3, 4), (4, 2)]
    rows = [(Iri(f"urn:e#{a}"), Iri("urn:e#p"), Iri(f"urn:e#{b}")) for a, b in edges]
    agp = parse_agp("?a e:p ?b . ?b e:p ?c . ?c e:p ?a", {"e": "urn:e#"})
    live = IncrementalPattern(spark, agp, f"file://{tmp_path}/i")
    for i in range(3):
        live.feed(frame(spark, rows[2 * i : 2 * i + 2]), i)
        live.feed(frame(spark, rows[2 * i : 2 * i + 2]), i)
    every = spark.read.parquet(*(f"file://{tmp_path}/i/answers/{i:09d}" for i in range(3)))
    want = {(a, b, d) for a, b in edges for c, d in edges if b == c for x, y in edges if x == d and y == a}
    got = every.collect()
    assert len(got) == len(want) and {tuple(int(x[6:]) for x in r) for r in got} == want


def test_cycles_are_followed_to_the_end(spark):
    v = Vocabulary()
    v.add(HEAD + "<urn:e> a owl:Ontology . e:A a owl:Class . e:next a owl:ObjectProperty ; rdfs:domain e:A ; rdfs:range e:A . e:name a owl:DatatypeProperty ; rdfs:domain e:A .")
    v.seeds.add("urn:d:0", "urn:e#A")
    text = "".join(f"<urn:d:{i}> e:next <urn:d:{i + 1}> ; e:name '{i}' . " for i in range(6)) + "<urn:d:6> e:next <urn:d:0> ; e:name '6' . <urn:d:8> e:name '8' ."
    s = Session(spark, TripleStore(frame(spark, parse_turtle(HEAD + text)[0])), v, {"e": "urn:e#"})
    assert sorted(r[0] for r in s.sparql("SELECT ?n WHERE { ?x e:name ?n }", scope="reachable").collect()) == [str(i) for i in range(7)]


def test_turtle(spark, tmp_path):
    text = HEAD + '<urn:a> e:p [ e:q "x"@en , 5 , 2.5 , true ; e:r ( 1 2 ) ] ; a e:C . # end\n_:z e:p """long "text" \\u00e9""" .'
    triples, prefixes = parse_turtle(text)
    assert len(triples) == 2 + 4 + 1 + 4 + 1 and prefixes["e"] == "urn:e#"
    assert collections.Counter(p for _, p, _ in parse_turtle(write_turtle(triples, prefixes))[0]) == collections.Counter(p for _, p, _ in triples)
    assert set(deskolemise(skolemise(triples))) == set(triples)
    (tmp_path / "a.ttl").write_text(text)
    (tmp_path / "b.ttl").write_text(text)
    df = read_turtle(spark, str(tmp_path))
    assert df.count() == 24 and df.filter("s.kind = 1").select("s.lex").distinct().count() == 2 * 4
    for bad in ("?x <urn:p> 1 .", '"a" <urn:p> 1 .', "<urn:a> <urn:p> ."):
        with pytest.raises(ValueError):
            parse_turtle(bad)


def test_resource_cache(spark, tmp_path):
    now, calls = [100.0], []

    def load(gid):
        calls.append(gid)
        return f"data of {gid} {len(calls)}", {"Cache-Control": "public, max-age=7.2"}

    cache = ResourceCache(spark, f"file://{tmp_path}/r", clock=lambda: now[0])
    assert cache.create("urn:a", load) == cache.create("urn:a", load) == "data of urn:a 1"
    cache.create("urn:b", load)
    assert cache.search("a") == ["urn:a"] and len(calls) == 2
    now[0] += 8.5
    assert cache.create("urn:a", load) == "data of urn:a 3"
    cache.purge()
    assert spark.read.parquet(f"file://{tmp_path}/r").count() == 1
    cache.expire("urn:a")
    assert cache.search("") == []
    assert ttl_of({"Expires": "Thu, 01 Jan 1970 00:02:00 GMT"}, 100) == 20 and ttl_of({}) is None and ttl_of({"Expires": "0"}) is None


def test_json_document(spark):
    import json

    from graphloom.plans.compiler import Compiler

    s = sensor_session(spark)
    doc = json.loads("".join(json_lines(Compiler(spark, s.data), "SELECT ?s ?l ?none WHERE { ?s e:label ?l }", s.prefixes)))
    assert doc == {"head": {"vars": ["s", "l", "none"]}, "results": {"bindings": [{"s": {"type": "uri", "value": "urn:d:k1"}, "l": {"type": "literal", "value": "CO2"}}]}}


def test_scans_are_pruned_and_filters_pushed(spark):
    s = tables.session(spark, "/root/testdata/sf0.001")
    plan = s.sparql("SELECT ?k WHERE { ?o t:o_orderkey ?k ; t:o_totalprice ?p FILTER(?p > 400000) }")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,400000.0)" in plan and "o_orderdate" not in plan and plan.count("FileScan") == 1 and "Exchange" not in plan


def test_registered_queries_have_names_and_sql():
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())
    assert NS in s if (s := E.oracle_sql().get("graph_named")) else True
