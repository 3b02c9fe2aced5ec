"""Queries over a vocabulary that is made from the customers' nations, regions and segments.

A nation is a class below its region, a region one below Place.  ``serves_<segment>`` leads from the
nations that have customers of a segment to the segment's class, ``from_<segment>`` back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.terms import OWL, RDF_TYPE, RDFS
from graphloom.operators.facts import FactTables

NS = "urn:market#"


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o) of the vocabulary."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select("n_name", "r_name", "c_mktsegment").distinct()
    at = lambda kind, c: F.concat(F.lit(NS + kind), F.replace(c, F.lit(" "), F.lit("_")))
    n, r, s = at("nation/", F.col("n_name")), at("region/", F.col("r_name")), at("segment/", F.col("c_mktsegment"))
    serves, back, balance = (at(k, F.col("c_mktsegment")) for k in ("serves_", "from_", "balance_"))
    lit = lambda x: F.lit(x)
    found = [
        (n, RDF_TYPE, lit(OWL + "Class")), (n, RDFS + "subClassOf", r), (r, RDFS + "subClassOf", lit(NS + "Place")), (serves, RDF_TYPE, lit(OWL + "ObjectProperty")), (serves, RDFS + "domain", n), (serves, RDFS + "range", s),
        (back, RDF_TYPE, lit(OWL + "ObjectProperty")), (back, OWL + "inverseOf", serves), (balance, RDF_TYPE, lit(OWL + "DatatypeProperty")), (balance, RDFS + "domain", s),
        (lit(NS + "name"), RDF_TYPE, lit(OWL + "DatatypeProperty")), (lit(NS + "name"), RDFS + "domain", lit(NS + "Place")),
    ]
    each = F.explode(F.array(*(F.struct(T.make(T.IRI, a).alias("s"), F.lit(p).alias("p"), T.make(T.IRI, b).alias("o")) for a, p, b in found)))
    return rows.select(each.alias("t")).select("t.*").distinct()


def _short(df: DataFrame) -> DataFrame:
    return df.select(*(F.replace(c, F.lit(NS), F.lit("")).alias(c) for c in df.columns))


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = getattr(FactTables(spark, vocabulary(spark, sf_dir)), name)
        return _short(found() if callable(found) else found)

    return run


_M = (
    "m AS (SELECT DISTINCT 'nation/' || replace(n_name, ' ', '_') AS n, 'region/' || replace(r_name, ' ', '_') AS r, replace(c_mktsegment, ' ', '_') AS s"
    " FROM customer JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey)"
)
_W, _WR = f"WITH {_M} ", f"WITH RECURSIVE {_M}, "
_E = "SELECT n AS class, 'serves_' || s AS property, 'segment/' || s AS range FROM m UNION SELECT 'segment/' || s, 'from_' || s, n FROM m"
_BELOW = "SELECT 'Place' AS c UNION SELECT r FROM m UNION SELECT n FROM m"
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "market_types": (_query("types"), f"{_W} SELECT c AS type FROM ({_BELOW} UNION SELECT 'segment/' || s FROM m)"),
    "market_properties": (_query("properties"), f"{_W} SELECT DISTINCT unnest(['serves_' || s, 'from_' || s, 'balance_' || s, 'name']) AS property, unnest(['object', 'object', 'data', 'data']) AS kind FROM m"),
    "market_closure": (_query("closure"), f"{_W} SELECT n AS class, r AS super FROM m UNION SELECT n, 'Place' FROM m UNION SELECT r, 'Place' FROM m"),
    "market_inverses": (_query("inverses"), f"{_W} SELECT 'serves_' || s AS property, 'from_' || s AS inverse FROM m UNION SELECT 'from_' || s, 'serves_' || s FROM m"),
    "market_domains": (_query("domains"), f"{_W} SELECT 'serves_' || s AS property, n AS class FROM m UNION SELECT unnest(['from_' || s, 'balance_' || s]), 'segment/' || s FROM m UNION SELECT 'name', c FROM ({_BELOW})"),
    "market_ranges": (_query("ranges"), f"{_W} SELECT 'serves_' || s AS property, 'segment/' || s AS class FROM m UNION SELECT 'from_' || s, n FROM m"),
    "market_members": (
        _query("members"),
        f"{_W} SELECT n AS class, 'serves_' || s AS property, 'own' AS how FROM m UNION SELECT 'segment/' || s, unnest(['from_' || s, 'balance_' || s]), 'own' FROM m UNION SELECT c, 'name', CASE WHEN c='Place' THEN 'own' ELSE 'inherited' END FROM ({_BELOW})",
    ),
    "market_references": (_query("references"), f"{_W} SELECT 'segment/' || s AS class, 'serves_' || s AS property, 'own' AS how FROM m UNION SELECT n, 'from_' || s, 'own' FROM m"),
    "market_edges": (_query("edges"), f"{_W} {_E}"),
    "market_connected": (_query("connected"), f"{_WR} e AS ({_E}), c(source, target) AS (SELECT class, range FROM e UNION SELECT c.source, e.range FROM c JOIN e ON e.class=c.target) SELECT source, target FROM c"),
}
