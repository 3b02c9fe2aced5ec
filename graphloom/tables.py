"""The class model of the star-schema tables: classes, links, ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.vocabulary import Vocabulary
from graphloom.session import Session
from graphloom.sources.mapping import Mapping, TableClass

NS = "urn:tables#"
DATA = "urn:data:"
PREFIXES = {"t": NS}

_ROW = "md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate))"

#: class → (table, key, columns, links as property → (key, class))
_CLASSES = {
    "Region": ("region", "r_regionkey", "r_regionkey r_name", {}),
    "Nation": ("nation", "n_nationkey", "n_nationkey n_name", {"inRegion": ("n_regionkey", "Region")}),
    "Customer": ("customer", "c_custkey", "c_custkey c_name c_nationkey c_acctbal c_mktsegment", {"inNation": ("c_nationkey", "Nation")}),
    "Supplier": ("supplier", "s_suppkey", "s_suppkey s_name s_nationkey s_acctbal", {"inNation": ("s_nationkey", "Nation")}),
    "Part": ("part", "p_partkey", "p_partkey p_name p_brand p_type p_size p_retailprice", {}),
    "Order": ("orders", "o_orderkey", "o_orderkey o_orderstatus o_totalprice o_orderdate o_orderpriority", {"placedBy": ("o_custkey", "Customer")}),
    "LineItem": ("lineitem", _ROW, "l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", {"ofOrder": ("l_orderkey", "Order"), "ofPart": ("l_partkey", "Part"), "suppliedBy": ("l_suppkey", "Supplier")}),
    "Event": ("events", "event_id", "event_id ts event_type value props", {"byUser": ("user_id", "User")}),
    "Document": ("documents", "doc_id", "doc_id text lang source n_chars", {}),
    "Label": ("labels", "doc_id", "quality toxic", {"about": ("doc_id", "Document")}),
    "Page": ("pages", "page_id", "page_id url html", {}),
    "Turn": ("conversations", "concat(conv_id, '_', turn)", "conv_id turn role text", {"follows": ("if(turn > 0, concat(conv_id, '_', turn - 1), null)", "Turn")}),
    "Item": ("benchmark", "item_id", "item_id text", {}),
    "Vector": ("embeddings", "vec_id", "vec_id label", {}),
}
INVERSES = {"hasNation": "inRegion", "hasParty": "inNation", "placed": "placedBy", "hasItem": "ofOrder", "supplies": "suppliedBy", "followedBy": "follows", "partOf": "ofPart", "triggered": "byUser"}


def mapping(spark: SparkSession, sf_dir: str, read=None) -> Mapping:
    known: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in known:
            known[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return known[name]

    classes = {}
    for name, (source, key, columns, links) in _CLASSES.items():
        iri = NS + name
        classes[iri] = TableClass(iri, source, key, f"{DATA}{source}/", {NS + c: c for c in columns.split()}, {NS + p: (k, NS + c) for p, (k, c) in links.items()}, key == _ROW)
    return Mapping(classes, read or table, {NS + a: NS + b for a, b in INVERSES.items()}, {NS + "Party": (NS + "Customer", NS + "Supplier")})


def ontology() -> str:
    """The model as OWL."""
    out = [f"@prefix t: <{NS}> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .", "<urn:tables> a owl:Ontology .", "t:Party a owl:Class . t:User a owl:Class . t:Customer rdfs:subClassOf t:Party . t:Supplier rdfs:subClassOf t:Party ."]
    domains: dict[str, list[str]] = {}
    for name, (_, _, columns, links) in _CLASSES.items():
        out.append(f"t:{name} a owl:Class .")
        for c in columns.split():
            domains.setdefault(c, []).append(name)
        for p, (_, target) in links.items():
            if p != "inNation":
                out.append(f"t:{p} a owl:ObjectProperty ; rdfs:domain t:{name} ; rdfs:range t:{target} .")
    out.append("t:inNation a owl:ObjectProperty ; rdfs:domain t:Party ; rdfs:range t:Nation .")
    out += [f"t:{a} a owl:ObjectProperty ; owl:inverseOf t:{b} ." for a, b in INVERSES.items()]
    out += [f"t:{c} a owl:DatatypeProperty ; rdfs:domain {', '.join('t:' + d for d in own)} ." for c, own in domains.items()]
    return "\n".join(out)


def session(spark: SparkSession, sf_dir: str, seeds: dict[str, list[str]] | None = None) -> Session:
    vocab = Vocabulary()
    vocab.add(ontology())
    for type_, iris in (seeds or {}).items():
        for iri in iris:
            vocab.seeds.add(iri, NS + type_)
    return Session(spark, mapping(spark, sf_dir), vocab, dict(PREFIXES))
