import pytest

from graphloom.functions.terms import XSD, BNode, Iri, Literal
from graphloom.operators.crawl import Crawl
from graphloom.operators.vocabulary import Duplicate, NotFound, VocabularyError
from graphloom.plans.agp import from_bgp
from graphloom.service import Client, Service
from graphloom.session import Session
from graphloom.sources.fragments import ResourceCache
from graphloom.sources.results import remote_quads
from graphloom.sources.triples import open_store, save
from graphloom.sources.dereference import ResourceWrapper, dereference, load, parse_rdf, parse_rdfxml
from tests.test_engine import DATA, HEAD, QUERY, SENSORS, sensor_session, sensors

RDFXML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:e#" xml:base="http://x/y">
 <e:C rdf:about="a" e:short="s"><e:p rdf:resource="#b"/><e:q xml:lang="EN">hi</e:q><e:n rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</e:n>
  <e:in><rdf:Description><e:z>1</e:z></rdf:Description></e:in><e:r rdf:parseType="Resource"><e:k>v</e:k></e:r><e:l rdf:parseType="Collection"><e:D rdf:about="d"/></e:l></e:C>
 <rdf:Seq rdf:ID="s"><rdf:li>one</rdf:li><rdf:li>two</rdf:li></rdf:Seq><rdf:Description rdf:nodeID="k"><e:p rdf:nodeID="k"/></rdf:Description>
</rdf:RDF>"""


def test_rdfxml():
    t = parse_rdfxml(RDFXML)
    a = Iri("http://x/a")
    assert (a, Iri("urn:e#p"), Iri("http://x/y#b")) in t and (a, Iri("urn:e#short"), Literal("s")) in t
    assert (a, Iri("urn:e#n"), Literal("5", XSD + "integer")) in t and (a, Iri("urn:e#q"), Literal("hi", None, "EN")) in t
    assert (Iri("http://x/y#s"), Iri("http://www.w3.org/1999/02/22-rdf-syntax-ns#_2"), Literal("two")) in t
    assert (BNode("k"), Iri("urn:e#p"), BNode("k")) in t and len(t) == 1 + 1 + 3 + 2 + 2 + 1 + 3 + 3 + 1
    assert parse_rdf("<a", "xml") is False and parse_rdf("nonsense", "turtle") is False
    assert len(parse_rdf(RDFXML, "turtle", {"Content-Type": "application/rdf+xml; charset=utf-8"})) == len(t)


def pages():
    """Each resource of the data as a page of its own."""
    lines = DATA.removeprefix(HEAD).replace("\n", " ").split(" . ")
    out = {}
    for x in lines:
        x = x.strip().rstrip(".").strip()
        if x:
            out[x.split(">")[0][1:]] = HEAD + x + " ."
    return out


class Pages:
    def __init__(self):
        self.pages = pages()

    def __call__(self, uri, format_):
        if format_ != "turtle":
            return False
        return (self.pages[uri], {"Cache-Control": "max-age=9"}) if uri in self.pages else True


def test_load_negotiates():
    assert load("urn:d:k1", Pages())[1:] == (9, "turtle")
    assert load("urn:none", Pages()) == ([], None, None)
    assert load("urn:x", lambda u, f: (RDFXML, {}) if f == "xml" else False)[2] == "xml"


def test_wrapper_routes_by_rule():
    w = ResourceWrapper("http://host:80/api")

    @w.intercept("/people/<name>")
    def person(name, lang="en"):
        return f'<urn:{name}> <urn:p> "{lang}" .', {}

    assert load("http://host:80/api/people/ann?lang=fr", w)[0] == [(Iri("urn:ann"), Iri("urn:p"), Literal("fr"))]
    assert w("http://host:80/api/none", "turtle") is None and w("http://other/api/people/x", "turtle") is None


def test_dereference_in_parallel(spark):
    df = dereference(spark.createDataFrame([("urn:d:k1",), ("urn:d:v1",), ("urn:d:v1",), ("urn:none",)], "uri string"), Pages())
    assert sorted((r.g, r.o.lex) for r in df.collect()) == [("urn:d:k1", "CO2"), ("urn:d:v1", "5")]


def test_crawl_collects_what_the_query_needs(spark):
    v = sensors()
    v.seeds.add("urn:d:c1", "urn:e#Container")
    s = Session(spark, None, v, {"e": "urn:e#"})
    crawl = Crawl(spark, v, Pages())
    found = crawl.collect(s.planner.plan(from_bgp(s.parse(QUERY).part.part)))
    assert [r.n for r in Session(spark, found, v, s.prefixes).sparql(QUERY).collect()] == ["5"]
    assert crawl.n_derefs == sum(crawl.levels) and found.df.filter("g = 'urn:d:c2'").count() == 0


class Keys(frozenset):
    """What a loop to a fixpoint asks of a table of keys, without Spark."""

    def join(self, other, _on, _how):
        return Keys(self - other)

    def unionByName(self, other):
        return Keys(self | other)

    def distinct(self):
        return self

    def isEmpty(self):
        return not self

    def count(self):
        return len(self)


def test_cycles_have_no_bound_of_rounds(monkeypatch):
    from types import SimpleNamespace

    from graphloom.functions.values import Kind
    from graphloom.operators import crawl, traversal
    from graphloom.operators.solutions import Solutions
    from graphloom.plans.planner import Tree

    monkeypatch.setattr(crawl.store, "checkpoint", lambda df: df)
    monkeypatch.setattr(traversal, "checkpoint", lambda df: df)
    n = 1500
    after = lambda keys: Keys(k + 1 for k in keys if k < n)
    tree = Tree("T", (0,), (), Iri("urn:r"), ((("x", "p"),),), 1)
    c = Crawl(SimpleNamespace(createDataFrame=lambda rows, _: Keys(r[0] for r in rows if r)), None, base="-")
    monkeypatch.setattr(c, "_load", lambda uris: None)
    monkeypatch.setattr(c, "_follow", lambda uris, prop: after(uris))
    assert c._reach(tree) == set(range(n + 1))
    t = traversal.Traversal(None, None, None)
    monkeypatch.setattr(t, "_functional", lambda *_: None)  # doubling has a test of its own
    monkeypatch.setattr(t, "follow", lambda at, prop: Solutions(after(at.df), at.kinds))
    seeds = Solutions(Keys([0]), {"at": Kind("iri", "urn:")})
    assert t.fixpoint(seeds, ["p"]).df == set(range(n + 1))
    c.most_rounds = t.most_rounds = 3
    with pytest.raises(RuntimeError):
        c._reach(tree)
    with pytest.raises(RuntimeError):
        t.fixpoint(seeds, ["p"])


def test_from_loads_graphs(spark):
    s = Session(spark, open_store(spark), sensors(), {"e": "urn:e#"}, loader=Pages())
    got = s.sparql("SELECT ?n FROM <urn:d:v1> FROM NAMED <urn:d:k1> WHERE { ?v e:literalValue ?n . GRAPH ?g { ?k e:label ?l } }").collect()
    assert [r.n for r in got] == ["5"]


def test_store_on_disk_reads_one_predicate(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    save(sensor_session(spark).data.df, path)
    s = Session(spark, open_store(spark, path), sensors(), {"e": "urn:e#"})
    assert sorted(r.n for r in s.sparql(QUERY).collect()) == ["5", "7"]
    df = s.sparql("SELECT ?n WHERE { ?v e:literalValue ?n }")
    assert "PartitionFilters: [isnotnull(p" in df._jdf.queryExecution().executedPlan().toString()


def test_cancel(spark):
    s = sensor_session(spark)
    with s.cancellable("t1"):
        assert "t1" in spark.getTags()
    assert "t1" not in spark.getTags() and s.cancel("t1") == []


def test_service_and_client(spark, tmp_path):
    cache = ResourceCache(spark, f"file://{tmp_path}/r", force=3600)
    cache.create("urn:d:k1", lambda gid: Pages()(gid, "turtle"))
    service = Service(sensor_session(spark), resources=cache).start()
    try:
        c = Client(service.url)
        assert c.get("vocabs") == ["e"] and len(c.get("types")) == 7 and c.get("prefixes")["e"] == "urn:e#"
        assert c.type("e:Hot")["super"] == ["urn:e#Observation"] and c.property("urn:e#contains")["type"] == "object"
        assert sorted(b["n"]["value"] for b in c.query(QUERY)) == ["5", "7"]
        assert c.ask("ASK { ?s e:label 'CO2' }") and not c.ask("ASK { ?s e:label 'CO' }")
        assert len(c.fragment(QUERY)) == 5 and all(x.count("·") == 3 for x in c.fragment(QUERY, "quad-min"))
        assert remote_quads(spark, service.url, QUERY).filter("o.lex = 'CO2'").count() == 1
        assert c.get("resources") == ["urn:d:k1"] and "CO2" in c.get("resources/urn:d:k1") and cache.published("urn:me").first().o == "urn:d:k1"
        assert "SearchTree" in c.search_plan("{ ?s e:monitors ?c }")
        key = c.add_seed("urn:d:o9", "e:Hot")
        assert c.get_seed(key)["uri"] == "urn:d:o9" and c.seeds_of("e:Observation") == ["urn:d:o9"] and len(c.digest("e:Hot")) == 24
        with pytest.raises(Duplicate):
            c.add_seed("urn:d:o9", "e:Hot")
        with pytest.raises(NotFound):
            c.add_seed("urn:d:o9", "e:None")
        c.delete_seed(key)
        assert c.seeds_of("e:Observation") == [] and c.paths("e:Value")["paths"][0]["steps"][0]["property"] == "urn:e#contains"
        assert c.add_vocabulary(HEAD.replace("e: <urn:e#>", "f: <urn:f#>") + "<urn:f> a owl:Ontology . f:Z a owl:Class .") == "f"
        c.update_vocabulary("e", SENSORS)
        c.delete_vocabulary("f")
        for bad in ("vocabs/none", "nothing", "types/e:None"):
            with pytest.raises(NotFound):
                c.get(bad)
        with pytest.raises(VocabularyError):
            c.query("SELECT nonsense")
        assert "_:" not in "".join(c._call("GET", "sparql", query="CONSTRUCT { ?s e:x ?l } WHERE { ?s e:label ?l }"))
    finally:
        service.stop()
