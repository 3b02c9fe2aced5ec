"""Registered queries of the vocabulary, plans, crawling, caches and formats, over small fixed ontologies and documents.

Each has SQL with the expected rows written out by hand from what OWL, RDF and HTTP
say, or a recursive query that finds them in another way.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import tables
from graphloom.functions.terms import BNODE, LITERAL, Iri, Var
from graphloom.operators.paths import Navigator
from graphloom.operators.vocabulary import Vocabulary
from graphloom.plans.agp import parse_agp
from graphloom.plans.planner import Planner
from graphloom.session import Session
from graphloom.sources import store
from graphloom.sources.triples import TripleStore, open_store, save
from graphloom.tables import DATA, NS

#: Stations hold sensors; sensors make readings, hot ones only hot readings; readings follow one another.
ZOO = """
@prefix w: <urn:w#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
<urn:w> a owl:Ontology .
w:Station a owl:Class . w:Sensor a owl:Class . w:Reading a owl:Class .
w:HotSensor rdfs:subClassOf w:Sensor , [ a owl:Restriction ; owl:onProperty w:makes ; owl:allValuesFrom w:HotReading ] .
w:HotReading rdfs:subClassOf w:Reading .
w:holds a owl:ObjectProperty ; rdfs:domain w:Station ; rdfs:range w:Sensor .
w:heldBy a owl:ObjectProperty ; owl:inverseOf w:holds .
w:makes a owl:ObjectProperty ; rdfs:domain w:Sensor ; rdfs:range w:Reading .
w:next a owl:ObjectProperty ; rdfs:domain w:Reading ; rdfs:range w:Reading .
w:value a owl:DatatypeProperty ; rdfs:domain w:Reading ; rdfs:range xsd:integer .
w:name a owl:DatatypeProperty ; rdfs:domain w:Station , w:Sensor .
"""
W = "urn:w#"
P = {"w": W}

#: Documents by IRI, the last as RDF/XML.
PAGES = {
    "urn:d:s1": "@prefix w: <urn:w#> . <urn:d:s1> a w:Station ; w:name 'north' ; w:holds <urn:d:n1> , <urn:d:n2> .",
    "urn:d:n1": "@prefix w: <urn:w#> . <urn:d:n1> a w:Sensor ; w:name 'a' ; w:makes <urn:d:r1> .",
    "urn:d:n2": "@prefix w: <urn:w#> . <urn:d:n2> a w:HotSensor ; w:name 'b' ; w:makes <urn:d:r3> .",
    "urn:d:r1": "@prefix w: <urn:w#> . <urn:d:r1> a w:Reading ; w:value 5 ; w:next <urn:d:r2> .",
    "urn:d:r2": "@prefix w: <urn:w#> . <urn:d:r2> a w:Reading ; w:value 7 .",
    "urn:d:r3": '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:w="urn:w#"><w:HotReading rdf:about="urn:d:r3"><w:value rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">41</w:value></w:HotReading></rdf:RDF>',
}
AGES = {"urn:d:s1": 500, "urn:d:n1": 90, "urn:d:n2": 70, "urn:d:r1": 60, "urn:d:r2": 80, "urn:d:r3": 300}


class Documents:
    """A loader over PAGES; documents say how long they may be kept."""

    def __call__(self, uri: str, format_: str):
        if uri not in PAGES:
            return None
        kind = "application/rdf+xml" if PAGES[uri].startswith("<rdf") else "text/turtle"
        return PAGES[uri], {"Content-Type": kind, "Cache-Control": f"max-age={AGES[uri]}"}


def _vocab() -> Vocabulary:
    v = Vocabulary()
    v.add(ZOO)
    return v


def _bare(x: str) -> str:
    return x.replace(W, "").replace(NS, "")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(_bare(x) if isinstance(x, str) else x for x in r) for r in rows], schema)


def _raised(f: Callable) -> str:
    try:
        f()
    except (ValueError, NotImplementedError, RuntimeError) as e:
        return type(e).__name__
    return "none"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{store.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Vocabulary


def vocab_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [tuple(r) for r in _vocab().frame(spark, "constraints").collect()]
    return _rows(spark, rows, "property string, class string, range string")


def vocab_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vocab()
    rows = [(c, p, "own" if p in v.facts.type_properties(c, True) else "inherited") for c, p in v.frame(spark, "members").collect()]
    return _rows(spark, rows, "class string, property string, how string")


def vocab_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vocab()
    rows = [(c, p, "own" if p in v.facts.type_references(c, True) else "inherited") for c, p in v.frame(spark, "references").collect()]
    return _rows(spark, rows, "class string, property string, how string")


def vocab_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index says of one class, one object and one data property."""
    f = _vocab().facts
    rows = [("type", k, " ".join(x)) for k, x in f.type(W + "HotSensor").items()]
    for p in ("makes", "value"):
        rows += [(p, k, " ".join(x) if isinstance(x, list) else x if isinstance(x, str) else " ".join(f"{c}>{'+'.join(r)}" for c, r in x.items())) for k, x in f.property(W + p).items()]
    return _rows(spark, rows, "what string, field string, said string")


def vocab_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add, list, get, update, delete, and what is refused; seeds of a class that is gone go with it."""
    v = Vocabulary()
    rows = [("add", v.add(ZOO), len(v.facts.types()))]
    v.seeds.add("urn:d:s1", W + "Station")
    v.seeds.add("urn:d:r1", W + "Reading")
    rows.append(("again", _raised(lambda: v.add(ZOO)), len(v.list())))
    rows.append(("no ontology", _raised(lambda: v.add("<urn:x> a <urn:y> .")), len(v.list())))
    copy = Vocabulary()
    rows.append(("get", copy.add(v.get("w")), len(copy.facts.types())))
    rows.append(("other id", _raised(lambda: v.update("w", ZOO.replace("urn:w", "urn:o").replace("prefix w:", "prefix o:").replace("w:", "o:"))), len(v.facts.types())))
    v.update("w", "@prefix w: <urn:w#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . <urn:w> a owl:Ontology . w:Station a owl:Class .")
    rows.append(("update", "w", len(v.facts.types())))
    rows.append(("seeds left", " ".join(u for _, u, _ in v.seeds.all()), len(v.seeds.all())))
    v.delete("w")
    rows.append(("delete", " ".join(v.list()), len(v.facts.types())))
    rows.append(("gone", _raised(lambda: v.get("w")), 0))
    return _rows(spark, rows, "step string, said string, n int")


def vocab_rdfxml_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An RDF/XML vocabulary that imports a Turtle one and one that can't be read."""
    owl, rdfs = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#"
    text = f"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="{owl}" xmlns:rdfs="{rdfs}" xmlns:x="urn:x#">
<owl:Ontology rdf:about="urn:x"><owl:imports rdf:resource="urn:w"/><owl:imports rdf:resource="urn:missing"/></owl:Ontology>
<owl:Class rdf:about="urn:x#Buoy"><rdfs:subClassOf rdf:resource="urn:w#Station"/></owl:Class></rdf:RDF>"""
    v = Vocabulary()
    v.add(text, {"urn:w": ZOO}.__getitem__)
    return spark.createDataFrame([("vocabularies", " ".join(v.list())), ("supers", " ".join(v.facts.supertypes("urn:x#Buoy"))), ("prefix", v.prefixes["x"])], "what string, said string")


def vocab_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vocab()
    v.add_prefixes({"d": "urn:d:"})
    s = Session(spark, TripleStore(spark.createDataFrame([], open_store(spark).df.schema)), v)
    agp = s.agps("SELECT * WHERE { d:s1 w:holds ?x }")[0][0]
    return spark.createDataFrame([(str(x),) for x in agp.patterns[0]], "term string")


def seed_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add, refuse, list by class with subclasses, get, delete."""
    s = _vocab().seeds
    key = s.add("urn:d:n1", W + "Sensor")
    rows = [("add", key), ("get", " ".join(s.get(key))), ("again", _raised(lambda: s.add("urn:d:n1", W + "Sensor"))), ("type", _raised(lambda: s.add("urn:d:n1", W + "None"))), ("iri", _raised(lambda: s.add("not an iri", W + "Sensor")))]
    s.add("urn:d:n2", W + "HotSensor")
    s.add("urn:d:s1", W + "Station")
    rows += [("sensors", " ".join(s.of_type(W + "Sensor"))), ("hot", " ".join(s.of_type(W + "HotSensor"))), ("types", " ".join(sorted(_bare(t) for t in s.types())))]
    s.delete(key)
    rows.append(("deleted", " ".join(s.of_type(W + "Sensor"))))
    s.delete_type(W + "Station")
    rows.append(("left", " ".join(u for _, u, _ in s.all())))
    return _rows(spark, rows, "step string, said string")


def vocab_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The navigation graph: hot sensors lead to hot readings only."""
    nav = Navigator(_vocab())
    return _rows(spark, [(c, p, r) for c, own in nav.edges.items() for p, r in own], "class string, property string, range string")


def vocab_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = Navigator(_vocab())
    names = ("Station", "Sensor", "HotSensor", "Reading", "HotReading")
    return _rows(spark, [(a, b) for a in names for b in names if nav.connected(W + a, W + b)], "source string, target string")


# Patterns and plans

_PATTERN = "{ ?s w:holds ?n . ?n w:makes ?r . ?r w:value ?v . ?x w:name ?m }"


def agp_wiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots, connected parts and the chains from a root to each pattern."""
    agp = parse_agp(_PATTERN, P)
    rows = [("root", str(r), "") for r in agp.roots()]
    rows += [("part", str(i), " ".join(agp.names()[t] for t in part.patterns)) for i, part in enumerate(agp.components())]
    rows += [("chain", agp.names()[t], " ".join(chain)) for t, chains in agp.paths_to(Var("s")).items() for chain in chains]
    rows += [("wire", str(n), " ".join(f"{agp.names()[t]}>{o}" for t, o in own)) for n, own in agp.wire().items() if own]
    return _rows(spark, rows, "what string, place string, said string")


def agp_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of each node, root types, and patterns that contradict the vocabulary."""
    v = _vocab()
    planner = Planner(v)
    agp = parse_agp(_PATTERN, P)
    types = planner.node_types(agp)
    rows = [(str(x), " ".join(sorted(map(_bare, ts)))) for x, ts in types.items()]
    rows += [(f"root {r}", " ".join(map(_bare, planner.root_types(agp, r, types)))) for r in agp.roots()]
    for text in ("{ ?x w:holds ?y . ?y w:value ?z }", "{ ?x w:none ?y }", "{ ?x a w:None }"):
        plan = planner.plan(parse_agp(text, P), {W + "Station": ["urn:d:s1"]})
        rows.append((text, f"{len(plan.warnings)} warning, empty {str(plan.empty).lower()}"))
    return _rows(spark, rows, "node string, said string")


def plan_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search trees with registered and with given seeds, and whether a type pattern must be checked."""
    v = _vocab()
    v.seeds.add("urn:d:s1", W + "Station")
    agp = parse_agp("{ ?n a w:HotSensor ; w:makes ?r . ?r w:value ?v }", P)
    rows = []
    for name, seeds in (("registered", None), ("given", {W + "Sensor": ["urn:d:n1", "urn:d:n2"]})):
        plan = Planner(v).plan(agp, seeds)
        for sp in plan.spaces:
            rows += [(name, t.from_type, " ".join(p for _, p in t.steps), " ".join(t.seeds), str(t.length)) for t in sp.trees]
            rows += [(name, "check", agp.names()[t], "", str(c).lower()) for t, c in sp.check_type.items()]
    return _rows(spark, rows, "seeds string, from_type string, steps string, iris string, said string")


def plan_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan as Turtle, read again and asked."""
    from graphloom.sources.triples import frame
    from graphloom.sources.turtle import parse_turtle

    v = _vocab()
    v.seeds.add("urn:d:s1", W + "Station")
    text = Planner(v).plan(parse_agp("{ ?n w:makes ?r . ?r w:value 5 }", P)).turtle()
    s = Session(spark, TripleStore(frame(spark, parse_turtle(text)[0])), v, {"plan": "urn:graphloom:plan#"})
    return s.sparql("SELECT ?kind (COUNT(*) AS ?n) WHERE { ?x a ?kind } GROUP BY ?kind")


# Documents


def _crawled(spark: SparkSession, text: str):
    from graphloom.operators.crawl import Crawl

    v = _vocab()
    v.seeds.add("urn:d:s1", W + "Station")
    crawl = Crawl(spark, v, Documents())
    found = crawl.collect(Planner(v).plan(parse_agp(text, P)))
    return v, crawl, found


def crawl_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of what is reached from one station, through documents in Turtle and RDF/XML and a cycle."""
    v, _, found = _crawled(spark, "{ ?s w:holds ?n . ?n w:makes ?r . ?r w:value ?v }")
    return Session(spark, found, v).sparql("SELECT ?n ?v WHERE { ?n w:makes ?r . ?r w:value ?v }")


def crawl_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many resources were loaded, and for how long what was found may be kept."""
    _, crawl, found = _crawled(spark, "{ ?s w:holds ?n . ?n w:makes ?r }")
    return spark.createDataFrame([("derefs", crawl.n_derefs), ("ttl", crawl.ttl()), ("triples", found.df.count())], "what string, n long")


def dereference_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by an own loader, with the seconds they may be kept; one that doesn't exist has no rows."""
    from graphloom.sources.dereference import dereference

    uris = spark.createDataFrame([(u,) for u in [*PAGES, "urn:d:none"]], "uri string")
    return dereference(uris, Documents(), with_ttl=True).select(F.replace("g", F.lit("urn:d:"), F.lit("")).alias("g"), F.replace("p", F.lit(W), F.lit("")).alias("p"), F.col("o.lex").alias("o"), "ttl")


def dereference_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A server on this machine that serves one resource as Turtle, one as RDF/XML only, and refuses one."""
    from graphloom.sources.dereference import load

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            asked = self.headers["Accept"]
            page = PAGES["urn:d:r3"] if self.path == "/xml" else PAGES["urn:d:r1"]
            code = 404 if self.path == "/none" else 406 if self.path == "/xml" and asked == "text/turtle" else 200
            self.send_response(code)
            self.send_header("Content-Type", asked)
            self.send_header("Cache-Control", "max-age=30")
            self.end_headers()
            if code == 200:
                self.wfile.write(page.encode())

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = []
        for path in ("/turtle", "/xml", "/none"):
            triples, ttl, worked = load(f"http://127.0.0.1:{server.server_port}{path}")
            rows.append((path, worked, ttl, len(triples)))
    finally:
        server.shutdown()
    return spark.createDataFrame(rows, "path string, format string, ttl int, triples int")


def resource_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions as resources by rules over path parts and query arguments."""
    from graphloom.sources.dereference import ResourceWrapper, dereference

    wrapper = ResourceWrapper("http://own.host/api")

    @wrapper.intercept("/region/<key>")
    def region(key: str, unit: str = "none"):
        return f'<http://own.host/api/region/{key}> <urn:w#name> "{key}", "{unit}" .', {}

    uris = spark.createDataFrame([("http://own.host/api/region/3",), ("http://own.host/api/region/4?unit=m",)], "uri string")
    return dereference(uris, wrapper).select(F.col("s.lex").alias("s"), F.col("o.lex").alias("o"))


def ttl_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to keep a response by its headers, at 2024-01-15 00:00:00 UTC."""
    from graphloom.sources.fragments import ttl_of

    cases = [
        ("age", {"Cache-Control": "public, max-age=60"}), ("fraction", {"cache-control": "max-age=1.5"}), ("expires", {"Expires": "Mon, 15 Jan 2024 00:02:00 GMT"}), ("over", {"Expires": "Sun, 14 Jan 2024 00:00:00 GMT"}),
        ("both", {"Cache-Control": "max-age=5", "Expires": "Mon, 15 Jan 2024 00:02:00 GMT"}), ("bad", {"Expires": "soon"}), ("none", {}),
    ]
    return spark.createDataFrame([(n, ttl_of(h, 1705276800.0)) for n, h in cases], "name string, ttl int")


def resource_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, read again, expire, run out of time, search, publish, purge."""
    from graphloom.sources.fragments import ResourceCache

    now = [1000.0]
    asked: list[str] = []

    def loader(gid: str):
        asked.append(gid)
        return f"{gid} at {now[0]:.0f}", {"Cache-Control": "max-age=100" if gid == "urn:d:a" else "max-age=1"}

    base = _folder(spark, "resources")
    cache = ResourceCache(spark, base, least=5, clock=lambda: now[0])
    rows = [("first", cache.create("urn:d:a", loader)), ("second", cache.create("urn:d:b", loader))]
    now[0] = 1004.0
    rows += [("kept", cache.create("urn:d:b", loader)), ("found by another", ResourceCache(spark, base, clock=lambda: now[0]).create("urn:d:b", loader))]
    now[0] = 1010.0
    rows += [("over", cache.create("urn:d:b", loader)), ("long", cache.create("urn:d:a", loader))]
    cache.expire("urn:d:a")
    rows += [("search", " ".join(cache.search("urn:d"))), ("published", " ".join(r.o for r in cache.published("urn:me").collect()))]
    rows += [("expired", cache.create("urn:d:a", loader)), ("loads", " ".join(asked))]
    now[0] = 1050.0
    cache.purge()
    rows.append(("purged", " ".join(cache.search(""))))
    return spark.createDataFrame(rows, "step string, said string")


def store_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples kept on disk by predicate, opened again; an empty store."""
    from graphloom.sources.mapping import triples_of

    path = _folder(spark, "triples")
    save(triples_of(tables.mapping(spark, sf_dir), [NS + "Customer"]), path)
    s = Session(spark, open_store(spark, path, disjoint=True), prefixes=dict(tables.PREFIXES))
    empty = Session(spark, open_store(spark)).sparql("SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }").first()[0]
    return s.sparql("SELECT ?seg (COUNT(?c) AS ?n) WHERE { ?c t:c_mktsegment ?seg } GROUP BY ?seg").withColumn("empty", F.lit(empty).cast("long"))


def fragment_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads of customers by arrival: each is kept once, and read up to a time."""
    from graphloom.sources.fragments import FragmentStream

    s = tables.session(spark, sf_dir, {"Region": [f"{DATA}region/{i}" for i in range(5)]})
    quads = s.fragment_quads("SELECT * WHERE { ?n t:inRegion ?r . ?r t:r_name ?name }")
    kept = FragmentStream(spark, _folder(spark, "stream"))
    new = [kept.put(quads.filter("s.lex < 'urn:data:nation/2'"), 1), kept.put(quads, 2), kept.put(quads, 3)]
    return spark.createDataFrame([(1, new[0], kept.get(1).count()), (2, new[1], kept.get(2).count()), (3, new[2], kept.get().count())], "ts int, added int, upto long")


def fragment_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observers see kept fragments and those to come; fragments of other seeds and those over go."""
    from graphloom.sources.fragments import FragmentCache

    now, seen = [0.0], []
    cache = FragmentCache(spark, _folder(spark, "fragments"), ttl=100, clock=lambda: now[0])
    s = tables.session(spark, sf_dir, {"Region": [f"{DATA}region/1"]})
    s.cache = cache
    quads = lambda name: s.fragment_quads(f"SELECT * WHERE {{ ?r t:hasNation ?n . ?n t:n_name ?{name} }}").count()
    rows = [("first", quads("a"), cache.hits)]
    cache.watch(lambda agp, df: seen.append(df.count()))
    rows += [("replayed", len(seen), seen[0]), ("renamed", quads("b"), cache.hits)]
    s.vocab.seeds.add(f"{DATA}region/2", NS + "Region")
    rows += [("more seeds", quads("a"), cache.hits), ("told", len(seen), seen[-1])]
    rows.append(("other seeds go", cache.purge(digest=s.vocab.digest(sorted(s.vocab.seeds.types()))), len(cache.catalog())))
    now[0] = 150.0
    rows += [("within grace", cache.purge(grace=100), len(cache.catalog())), ("over", cache.purge(), len(cache.catalog()))]
    return spark.createDataFrame(rows, "step string, n long, said long")


def rdf_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turtle files and N-Triples files with blank nodes of one label, which stay apart."""
    from graphloom.sources.turtle import read_ntriples, read_turtle

    rows = []
    texts = ['_:b1 <urn:w#name> "x" .\n_:b1 <urn:w#value> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .\n# a comment\n', '_:b1 <urn:w#name> "y\\n\\u00e9"@en .\n<urn:d:s1> <urn:w#holds> _:b1 .\n']
    for kind, read in (("nt", read_ntriples), ("ttl", read_turtle)):
        base = _folder(spark, kind)
        for i, text in enumerate(texts):
            store.write_text(spark, f"{base}/{i}.{kind}", text)
        df = read(spark, base)
        nodes = df.select(F.col("s").alias("x")).unionByName(df.select(F.col("o").alias("x"))).filter(F.col("x.kind") == BNODE).distinct().count()
        rows += [(kind, r.p, r.lex, r.dt, r.lang, nodes) for r in df.select("p", "o.lex", "o.dt", "o.lang", "o.kind").filter(F.col("kind") == LITERAL).collect()]
    return _rows(spark, rows, "format string, p string, lex string, dt string, lang string, nodes long")


def vocab_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' ontology written as Turtle and read again: statements by predicate."""
    from graphloom.sources.turtle import parse_turtle

    v = tables.session(spark, sf_dir).vocab
    triples, _ = parse_turtle(v.get(v.list()[0]))
    names = {"http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf:", "http://www.w3.org/2000/01/rdf-schema#": "rdfs:", "http://www.w3.org/2002/07/owl#": "owl:"}

    def short(p: str) -> str:
        for k, x in names.items():
            p = p.replace(k, x)
        return p

    return spark.createDataFrame([(short(p.value),) for _, p, _ in triples], "p string").groupBy("p").agg(F.count("*").alias("n"))


def service_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another engine's fragment, read over HTTP from a service on this machine."""
    from graphloom.service import Service
    from graphloom.sources.results import remote_quads

    service = Service(tables.session(spark, sf_dir, {"Region": [f"{DATA}region/3"]})).start()
    try:
        quads = remote_quads(spark, service.url, "SELECT * WHERE { ?r t:hasNation ?n . ?n t:n_name ?name }")
        rows = quads.select("tp", F.replace("s.lex", F.lit(DATA), F.lit("")), F.replace("o.lex", F.lit(DATA), F.lit(""))).collect()
    finally:
        service.stop()
    return spark.createDataFrame([tuple(r) for r in rows], "tp string, s string, o string")


# Evaluation


def refused_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not supported says so."""
    s = tables.session(spark, sf_dir)
    cases = {"describe": "DESCRIBE <urn:x>", "service": "SELECT * WHERE { SERVICE <urn:x> { ?s ?p ?o } }", "update": "INSERT DATA { <urn:x> <urn:y> 1 }", "star path": "SELECT * WHERE { ?x t:follows* ?y }"}
    return spark.createDataFrame([(k, _raised(lambda q=q: s.sparql(q)) != "none") for k, q in cases.items()], "form string, refused boolean")


def evaluation_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An own answer for patterns of one predicate, in place of the tables'."""
    from graphloom.functions.values import Kind
    from graphloom.operators.solutions import Solutions, column
    from graphloom.plans import algebra as A

    s = tables.session(spark, sf_dir)

    def hook(compiler, n):
        if isinstance(n, A.BGP) and all(t.p == Iri(NS + "own") for t in n.triples):
            df = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias(column("n")), F.length("n_name").cast("long").alias(column("k")))
            return Solutions(df, {"n": Kind("str"), "k": Kind("int")})
        return None

    s.hooks["own"] = hook
    return s.sparql("SELECT ?n ?k ?nk WHERE { ?x t:n_name ?n ; t:n_nationkey ?nk { ?y t:own ?z } FILTER(?k > 8) }")


def implicit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable of a grouped query that is no key stands for any of its values; here each group has one."""
    q = "SELECT ?nk (STR(?r) AS ?region) WHERE { ?n t:n_nationkey ?nk ; t:inRegion ?r } GROUP BY ?nk"
    return tables.session(spark, sf_dir).sparql(q)


def fragment_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern of two parts that share nothing: the quads of both."""
    s = tables.session(spark, sf_dir, {"Region": [f"{DATA}region/0"]})
    quads = s.fragment_quads("SELECT * WHERE { ?r t:r_name ?a . ?q t:hasNation ?n . ?n t:n_name ?b }")
    return quads.groupBy("tp").agg(F.count("*").alias("n"))


def reach_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one turn of a conversation, along a cycle of the vocabulary both ways, to all of it."""
    first = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", F.desc("turn")).first()
    s = tables.session(spark, sf_dir, {"Turn": [f"{DATA}conversations/{first.conv_id}_{first.turn}"]})
    return s.sparql("SELECT ?c ?n WHERE { ?x t:conv_id ?c ; t:turn ?n }", scope="reachable")


def reach_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders reached from one region, by customers, by suppliers and along the cycles, as the planner finds them."""
    s = tables.session(spark, sf_dir, {"Region": [f"{DATA}region/2"]})
    return s.sparql("SELECT ?k WHERE { ?o t:o_orderkey ?k ; t:o_orderstatus 'F' }", scope="reachable")


def cancelled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by a tag can be stopped; without any there is nothing to stop."""
    s = tables.session(spark, sf_dir)
    with s.cancellable("graphloom-none"):
        n = s.sparql("SELECT (COUNT(*) AS ?n) WHERE { ?r t:r_name ?x }").first()[0]
    return spark.createDataFrame([(n, len(s.cancel("graphloom-none")))], "n long, stopped int")


def json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPARQL JSON of a whole table, read again."""
    from graphloom.plans.compiler import Compiler
    from graphloom.sources.results import json_rows

    rows = json_rows(Compiler(spark, tables.mapping(spark, sf_dir)), "SELECT ?c ?b ?s WHERE { ?c t:c_acctbal ?b ; t:c_mktsegment ?s }", tables.PREFIXES)
    return rows.select(F.get_json_object("binding", "$.c.value").alias("c"), F.get_json_object("binding", "$.b.value").cast("double").alias("b"), F.get_json_object("binding", "$.s.value").alias("s"))


def _values(names: str, *rows: tuple) -> str:
    def lit(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (int, bool)) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


_TYPE, _INTEGER, _STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2001/XMLSchema#integer", "http://www.w3.org/2001/XMLSchema#string"
_EDGES = [("Station", "holds", "Sensor"), ("Station", "holds", "HotSensor"), ("Sensor", "heldBy", "Station"), ("Sensor", "makes", "Reading"), ("Sensor", "makes", "HotReading"), ("HotSensor", "makes", "HotReading"), ("Reading", "next", "Reading"), ("HotReading", "next", "Reading")]
#: Orders (o) reached from region 2 by customers (c: their nation) and suppliers (s), then along the vocabulary's cycles: to other orders of the
#: customer (k), to the customers of the nations of its items' suppliers, and to the suppliers of its customer's nation.
_REGION2 = """WITH RECURSIVE t AS (
  SELECT o_orderkey::BIGINT AS o, c_custkey::BIGINT AS k, c_nationkey::BIGINT AS cn, s_nationkey::BIGINT AS sn FROM orders JOIN customer ON o_custkey=c_custkey LEFT JOIN lineitem ON l_orderkey=o_orderkey LEFT JOIN supplier ON l_suppkey=s_suppkey
), e AS (
  SELECT DISTINCT 'c' AS f, cn AS x, 'o' AS g, o AS y FROM t UNION SELECT DISTINCT 's', sn, 'o', o FROM t UNION SELECT DISTINCT 'o', o, 'k', k FROM t UNION SELECT DISTINCT 'k', k, 'o', o FROM t
  UNION SELECT DISTINCT 'o', o, 'c', sn FROM t UNION SELECT DISTINCT 'o', o, 's', cn FROM t
), n AS (
  SELECT g, y FROM (SELECT unnest(['c', 's']) AS g, n_nationkey::BIGINT AS y FROM nation WHERE n_regionkey=2) UNION SELECT e.g, e.y FROM n JOIN e ON e.f = n.g AND e.x = n.y
) SELECT y FROM n WHERE g='o'"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    # A subclass has its superclass's properties; a class that has the inverse's range has the inverse.
    "vocab_constraints": (vocab_constraints, _values("property, class, range", ("makes", "HotSensor", "HotReading"))),
    "vocab_members": (
        vocab_members,
        _values(
            "class, property, how", ("Station", "name", "own"), ("Station", "holds", "own"), ("Sensor", "name", "own"), ("Sensor", "makes", "own"), ("Sensor", "heldBy", "own"), ("HotSensor", "makes", "own"),
            ("HotSensor", "name", "inherited"), ("HotSensor", "heldBy", "inherited"), ("Reading", "next", "own"), ("Reading", "value", "own"), ("HotReading", "next", "inherited"), ("HotReading", "value", "inherited"),
        ),
    ),
    "vocab_references": (
        vocab_references,
        _values("class, property, how", ("Sensor", "holds", "own"), ("HotSensor", "holds", "inherited"), ("Station", "heldBy", "own"), ("Reading", "makes", "own"), ("Reading", "next", "own"), ("HotReading", "makes", "own"), ("HotReading", "next", "inherited")),
    ),
    "vocab_index": (
        vocab_index,
        _values(
            "what, field, said", ("type", "super", "Sensor"), ("type", "sub", ""), ("type", "properties", "heldBy makes name"), ("type", "spec_properties", "makes"), ("type", "refs", "holds"), ("type", "spec_refs", ""),
            ("makes", "domain", "HotSensor Sensor"), ("makes", "range", "HotReading Reading"), ("makes", "inverse", ""), ("makes", "constraints", "HotSensor>HotReading"), ("makes", "type", "object"),
            ("value", "domain", "HotReading Reading"), ("value", "range", _INTEGER), ("value", "inverse", ""), ("value", "constraints", ""), ("value", "type", "data"),
        ),
    ),
    "vocab_lifecycle": (
        vocab_lifecycle,
        _values(
            "step, said, n", ("add", "w", 5), ("again", "Duplicate", 1), ("no ontology", "VocabularyError", 1), ("get", "w", 5), ("other id", "VocabularyError", 5), ("update", "w", 1), ("seeds left", "urn:d:s1", 1), ("delete", "", 0), ("gone", "NotFound", 0),
        ),
    ),
    "vocab_rdfxml_imports": (vocab_rdfxml_imports, _values("what, said", ("vocabularies", "w x"), ("supers", "urn:w#Station"), ("prefix", "urn:x#"))),
    "vocab_prefixes": (vocab_prefixes, _values("term", ("<urn:d:s1>",), ("<urn:w#holds>",), ("?x",))),
    "seed_lifecycle": (
        seed_lifecycle,
        "SELECT 'add' AS step, to_base64('urn:w#Sensor|urn:d:n1'::BLOB) AS said UNION ALL "
        + _values(
            "step, said", ("get", "Sensor urn:d:n1"), ("again", "Duplicate"), ("type", "NotFound"), ("iri", "VocabularyError"), ("sensors", "urn:d:n1 urn:d:n2"), ("hot", "urn:d:n2"), ("types", "HotSensor Sensor Station"), ("deleted", "urn:d:n2"), ("left", "urn:d:n2"),
        ),
    ),
    "vocab_edges": (vocab_edges, _values("class, property, range", *_EDGES)),
    "vocab_connected": (vocab_connected, f"WITH RECURSIVE e AS ({_values('source, property, target', *_EDGES)}), r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON r.target = e.source) SELECT source, target FROM r"),
    "agp_wiring": (
        agp_wiring,
        _values(
            "what, place, said", ("root", "?s", ""), ("root", "?x", ""), ("part", "0", "tp_0 tp_1 tp_2"), ("part", "1", "tp_3"), ("chain", "tp_0", ""), ("chain", "tp_1", "holds"), ("chain", "tp_2", "holds makes"),
            ("wire", "?s", "tp_0>?n"), ("wire", "?n", "tp_1>?r"), ("wire", "?r", "tp_2>?v"), ("wire", "?x", "tp_3>?m"),
        ),
    ),
    "agp_types": (
        agp_types,
        _values(
            "node, said", ("?s", "Station"), ("?n", "HotSensor Sensor"), ("?r", "HotReading Reading"), ("?x", "HotSensor Sensor Station"), ("root ?s", "Station"), ("root ?x", "Sensor Station"),
            ("{ ?x w:holds ?y . ?y w:value ?z }", "1 warning, empty true"), ("{ ?x w:none ?y }", "1 warning, empty true"), ("{ ?x a w:None }", "1 warning, empty true"),
        ),
    ),
    # A tree's length: for each pattern the steps to the root, the chain to its subject, and one.
    "plan_trees": (plan_trees, _values("seeds, from_type, steps, iris, said", ("registered", "Station", "holds", "urn:d:s1", "7"), ("registered", "check", "tp_0", "", "true"), ("given", "Sensor", "heldBy holds", "urn:d:n1 urn:d:n2", "10"), ("given", "check", "tp_0", "", "true"))),
    "plan_graph": (plan_graph, "SELECT 'urn:graphloom:plan#' || k AS kind, n::BIGINT AS n FROM (VALUES ('Variable', 2), ('SearchTree', 1), ('Literal', 1), ('SearchSpace', 1), ('TriplePattern', 2), ('Cycle', 1)) v(k, n)"),
    "crawl_documents": (crawl_documents, _values("n, v", ("urn:d:n1", "5"), ("urn:d:n2", "41"))),
    "crawl_metrics": (crawl_metrics, "SELECT what, n::BIGINT AS n FROM (VALUES ('derefs', 3), ('ttl', 70), ('triples', 10)) v(what, n)"),
    "dereference_loader": (
        dereference_loader,
        "SELECT g, p, o, ttl::BIGINT AS ttl FROM ("
        + _values(
            "g, p, o, ttl", ("s1", _TYPE, "urn:w#Station", 500), ("s1", "name", "north", 500), ("s1", "holds", "urn:d:n1", 500), ("s1", "holds", "urn:d:n2", 500), ("n1", _TYPE, "urn:w#Sensor", 90), ("n1", "name", "a", 90),
            ("n1", "makes", "urn:d:r1", 90), ("n2", _TYPE, "urn:w#HotSensor", 70), ("n2", "name", "b", 70), ("n2", "makes", "urn:d:r3", 70), ("r1", _TYPE, "urn:w#Reading", 60), ("r1", "value", "5", 60), ("r1", "next", "urn:d:r2", 60),
            ("r2", _TYPE, "urn:w#Reading", 80), ("r2", "value", "7", 80), ("r3", _TYPE, "urn:w#HotReading", 300), ("r3", "value", "41", 300),
        )
        + ")",
    ),
    "dereference_http": (dereference_http, _values("path, format, ttl, triples", ("/turtle", "turtle", 30, 3), ("/xml", "xml", 30, 2), ("/none", None, None, 0))),
    "resource_functions": (resource_functions, _values("s, o", ("http://own.host/api/region/3", "3"), ("http://own.host/api/region/3", "none"), ("http://own.host/api/region/4", "4"), ("http://own.host/api/region/4", "m"))),
    "ttl_headers": (ttl_headers, _values("name, ttl", ("age", 60), ("fraction", 2), ("expires", 120), ("over", 0), ("both", 5), ("bad", None), ("none", None))),
    "resource_cache": (
        resource_cache,
        _values(
            "step, said", ("first", "urn:d:a at 1000"), ("second", "urn:d:b at 1000"), ("kept", "urn:d:b at 1000"), ("found by another", "urn:d:b at 1000"), ("over", "urn:d:b at 1010"), ("long", "urn:d:a at 1000"),
            ("search", "urn:d:b"), ("published", "urn:d:b"), ("expired", "urn:d:a at 1010"), ("loads", "urn:d:a urn:d:b urn:d:b urn:d:a"), ("purged", ""),
        ),
    ),
    "store_reopened": (store_reopened, "SELECT c_mktsegment AS seg, count(*) AS n, 0::BIGINT AS empty FROM customer GROUP BY 1"),
    "fragment_stream": (
        fragment_stream,
        "WITH x AS (SELECT (SELECT count(*) FROM nation WHERE n_nationkey::VARCHAR < '2') AS few, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS every)"
        " SELECT 1 AS ts, few::INTEGER AS added, few AS upto FROM x UNION ALL SELECT 2, (every - few)::INTEGER, every FROM x UNION ALL SELECT 3, 0, every FROM x",
    ),
    "fragment_registry": (
        fragment_registry,
        "WITH x AS (SELECT count(*) FILTER (n_regionkey = 1) * 2 AS one, count(*) FILTER (n_regionkey IN (1, 2)) * 2 AS two FROM nation)"
        " SELECT 'first' AS step, one AS n, 0::BIGINT AS said FROM x UNION ALL SELECT 'replayed', 1, one FROM x UNION ALL SELECT 'renamed', one, 1 FROM x UNION ALL SELECT 'more seeds', two, 1 FROM x"
        " UNION ALL SELECT 'told', 2, two FROM x UNION ALL SELECT 'other seeds go', 1, 1 UNION ALL SELECT 'within grace', 0, 1 UNION ALL SELECT 'over', 1, 0",
    ),
    "rdf_formats": (
        rdf_formats,
        "SELECT f AS format, p, lex, dt, lang, 2::BIGINT AS nodes FROM (VALUES ('nt'), ('ttl')) a(f), (VALUES ('name', 'x', '" + _STRING + "', NULL), ('value', '1', '" + _INTEGER + "', NULL), ('name', 'y' || chr(10) || 'é', NULL, 'en')) b(p, lex, dt, lang)",
    ),
    # 14 classes of tables, Party and User; 16 object and 54 data properties; Ontology.
    "vocab_turtle": (vocab_turtle, "SELECT p, n::BIGINT AS n FROM (VALUES ('rdf:type', 87), ('rdfs:domain', 64), ('rdfs:range', 9), ('rdfs:subClassOf', 2), ('owl:inverseOf', 8)) v(p, n)"),
    "service_fragment": (service_fragment, "SELECT 'tp_0' AS tp, 'region/3' AS s, 'nation/' || n_nationkey AS o FROM nation WHERE n_regionkey = 3 UNION ALL SELECT 'tp_1', 'nation/' || n_nationkey, n_name FROM nation WHERE n_regionkey = 3"),
    "refused_forms": (refused_forms, _values("form, refused", ("describe", True), ("service", True), ("update", True), ("star path", True))),
    "evaluation_hook": (evaluation_hook, "SELECT n_name AS n, length(n_name) AS k, n_nationkey::BIGINT AS nk FROM nation WHERE length(n_name) > 8"),
    "implicit_sample": (implicit_sample, "SELECT n_nationkey::BIGINT AS nk, 'urn:data:region/' || n_regionkey AS region FROM nation"),
    "fragment_spaces": (fragment_spaces, "SELECT 'tp_0' AS tp, 1::BIGINT AS n UNION ALL SELECT unnest(['tp_1', 'tp_2']), count(*) FROM nation WHERE n_regionkey = 0"),
    "reach_conversation": (reach_conversation, "SELECT conv_id AS c, turn AS n FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)"),
    "reach_orders": (reach_orders, f"SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT * FROM ({_REGION2}))"),
    "cancelled_jobs": (cancelled_jobs, "SELECT count(*) AS n, 0 AS stopped FROM region"),
    "json_text": (json_text, "SELECT 'urn:data:customer/' || c_custkey AS c, c_acctbal AS b, c_mktsegment AS s FROM customer"),
}
