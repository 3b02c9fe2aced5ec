"""What follows from a vocabulary, as tables: for vocabularies that are data themselves, of any size.

The same facts as ``vocabulary.Facts`` gives, computed by joins over the vocabulary's triples; classes and
properties are IRIs as text.  Restrictions (anonymous superclasses) are not looked at.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.terms import OWL, RDF, RDF_TYPE, RDFS, Iri
from graphloom.operators.closure import AT, TO, Paths
from graphloom.operators.solutions import column
from graphloom.operators.vocabulary import STD
from graphloom.sources.store import checkpoint
from graphloom.sources.triples import TripleStore


class FactTables:
    """``triples``: (s, p, o) with term structs."""

    def __init__(self, spark: SparkSession, triples: DataFrame):
        self.spark = spark
        self.triples = triples.filter((F.col("s.kind") == T.IRI) & (F.col("o.kind") == T.IRI))

    def pairs(self, p: str) -> DataFrame:
        return self.triples.filter(F.col("p") == p).select(F.col("s.lex").alias("a"), F.col("o.lex").alias("b")).distinct()

    def _of(self, *kinds: str) -> DataFrame:
        return self.pairs(RDF_TYPE).filter(F.col("b").isin(*kinds)).select(F.col("a").alias("x")).distinct()

    @cached_property
    def properties(self) -> DataFrame:
        """(property, kind): object or data."""
        named = self._of(RDF + "Property", OWL + "ObjectProperty", OWL + "DatatypeProperty")
        objects = self._of(OWL + "ObjectProperty").withColumn("object", F.lit(True))
        return checkpoint(named.join(objects, "x", "left").select(F.col("x").alias("property"), F.when(F.col("object"), "object").otherwise("data").alias("kind")))

    @cached_property
    def types(self) -> DataFrame:
        """(type) of all classes but the standard ones."""
        known = self.properties.select(F.col("property").alias("a"), "kind")
        declared = self._of(OWL + "ObjectProperty", OWL + "DatatypeProperty").select(F.col("x").alias("a"))
        parts = [
            self.pairs(RDFS + "domain").join(declared, "a").select(F.col("b").alias("type")),
            self.pairs(RDFS + "range").join(known.filter("kind = 'object'"), "a").select(F.col("b").alias("type")),
            self._of(OWL + "Class", RDFS + "Class").select(F.col("x").alias("type")),
            self.pairs(RDFS + "subClassOf").select(F.explode(F.array("a", "b")).alias("type")),
        ]
        own = reduce(DataFrame.unionByName, parts).distinct()
        for start in STD if isinstance(STD, (tuple, list)) else (STD,):
            own = own.filter(~F.startswith("type", F.lit(start)))
        return checkpoint(own)

    @cached_property
    def closure(self) -> DataFrame:
        """(class, super), a class itself left out."""
        store = TripleStore(self.triples.select(F.lit(None).cast("string").alias("g"), "s", "p", "o"))
        found = Paths(self.spark, store).pairs(("+", ("p", Iri(RDFS + "subClassOf")))).df
        return checkpoint(found.select(F.col(f"{column(AT)}.lex").alias("class"), F.col(f"{column(TO)}.lex").alias("super")).filter("class <> super").distinct())

    @cached_property
    def inverses(self) -> DataFrame:
        """(property, inverse), both ways."""
        own = self.pairs(OWL + "inverseOf").select(F.col("a").alias("property"), F.col("b").alias("inverse"))
        return checkpoint(own.unionByName(own.select(F.col("inverse").alias("property"), F.col("property").alias("inverse"))).distinct())

    def _asserted(self, end: str) -> DataFrame:
        return self.pairs(RDFS + end).select(F.col("a").alias("property"), F.col("b").alias("class"))

    def _below(self, pairs: DataFrame) -> DataFrame:
        """With the subclasses of each class."""
        under = pairs.join(self.closure.select(F.col("super").alias("class"), F.col("class").alias("sub")), "class").select("property", F.col("sub").alias("class"))
        return pairs.unionByName(under).distinct()

    def _turned(self, pairs: DataFrame) -> DataFrame:
        """What holds for a property's inverses."""
        return self.inverses.join(pairs.withColumnRenamed("property", "inverse"), "inverse").select("property", "class").distinct()

    def domains(self) -> DataFrame:
        """(property, class): where a property can begin, by its own domain or its inverse's range."""
        return self._below(self._asserted("domain")).unionByName(self._turned(self._below(self._asserted("range")))).distinct()

    def ranges(self) -> DataFrame:
        return self._below(self._asserted("range")).unionByName(self._turned(self._below(self._asserted("domain")))).distinct()

    def _told(self, end: str, other: str) -> DataFrame:
        own = self._asserted(end).unionByName(self._turned(self._asserted(other))).join(self.properties.select("property"), "property", "left_semi").distinct()
        inherited = own.join(self.closure.select(F.col("super").alias("class"), F.col("class").alias("sub")), "class").select("property", F.col("sub").alias("class"))
        both = own.withColumn("n", F.lit(1)).unionByName(inherited.withColumn("n", F.lit(0)))
        return both.groupBy("class", "property").agg(F.when(F.max("n") == 1, "own").otherwise("inherited").alias("how"))

    def members(self) -> DataFrame:
        """(class, property, how): properties of a class, its own or inherited."""
        return self._told("domain", "range")

    def references(self) -> DataFrame:
        """(class, property, how): properties that lead to a class."""
        return self._told("range", "domain")

    def edges(self) -> DataFrame:
        """(class, property, range): the graph along which plans lead."""
        objects = self.properties.filter("kind = 'object'").select("property")
        own_m, own_r = (x.filter("how = 'own'").select("class", "property") for x in (self.members(), self.references()))
        led = own_r.select("class").distinct().withColumn("led", F.lit(True))
        leads = own_m.select("class").distinct().withColumn("leads", F.lit(True))
        here = own_m.withColumn("here", F.lit(True))
        there = own_r.withColumn("there", F.lit(True))
        source = self.domains().join(objects, "property", "left_semi").join(led, "class", "left").join(here, ["class", "property"], "left").filter("led or here")
        target = self.ranges().join(leads, "class", "left").join(there, ["class", "property"], "left").filter("leads or there")
        return source.select("property", "class").join(target.select("property", F.col("class").alias("range")), "property").select("class", "property", "range").distinct()

    def connected(self) -> DataFrame:
        """(source, target): classes that some chain of edges joins."""
        e = self.edges().select("class", "range").distinct()
        triples = e.select(F.lit(None).cast("string").alias("g"), T.make(T.IRI, F.col("class")).alias("s"), F.lit("urn:edge").alias("p"), T.make(T.IRI, F.col("range")).alias("o"))
        found = Paths(self.spark, TripleStore(checkpoint(triples), disjoint=True)).pairs(("+", ("p", Iri("urn:edge")))).df
        return found.select(F.col(f"{column(AT)}.lex").alias("source"), F.col(f"{column(TO)}.lex").alias("target"))
