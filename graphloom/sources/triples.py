"""Generic triples: a DataFrame (g, s, p, o) with term structs for s and o."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import terms
from graphloom.functions import values as V
from graphloom.functions.terms import Iri, Term, Var
from graphloom.functions.values import Kind
from graphloom.operators import solutions as S
from graphloom.plans.algebra import Triple

SCHEMA = T.StructType([T.StructField("g", T.StringType()), T.StructField("s", terms.TERM), T.StructField("p", T.StringType()), T.StructField("o", terms.TERM)])


def frame(spark: SparkSession, triples: list[tuple[Term, Term, Term]], graph: str | None = None) -> DataFrame:
    """Triples made on the driver, such as a parsed file."""
    return spark.createDataFrame([(graph, terms.row(s), p.value, terms.row(o)) for s, p, o in triples], SCHEMA)


@dataclass
class TripleStore:
    """A dataset of triples; patterns are filtered scans joined on their variables.

    ``disjoint``: no triple stands twice, in one graph or in two; then a scan of
    several graphs needs no shuffle to make a set of them.
    """

    df: DataFrame
    graph: Term | None = None
    default: tuple[str, ...] | None = None  # the graphs that make up the default graph; None: all
    named: tuple[str, ...] | None = None
    disjoint: bool = False
    ttl: float | None = None  # seconds for which what was found may be kept, where its resources say so

    def inside(self, name: Term) -> TripleStore:
        return TripleStore(self.df, name, self.default, self.named, self.disjoint)

    def with_graphs(self, default: tuple[str, ...], named: tuple[str, ...]) -> TripleStore:
        return TripleStore(self.df, self.graph, default, named, self.disjoint)

    def _rows(self) -> DataFrame:
        if isinstance(self.graph, Iri):
            out = self.df.filter(F.col("g") == self.graph.value)
            return out.filter(F.lit(self.named is None or self.graph.value in self.named))
        if isinstance(self.graph, Var):
            out = self.df.filter(F.col("g").isNotNull())
            return out if self.named is None else out.filter(F.col("g").isin(*self.named))
        if self.default is not None:
            return self.df.filter(F.col("g").isin(*self.default)) if self.default else self.df.filter(F.lit(False))
        return self.df

    def bgp(self, triples: tuple[Triple, ...], spark: SparkSession) -> S.Solutions:
        return S.join_all([self._scan(t) for t in sorted(triples, key=lambda t: sum(isinstance(x, Var) for x in t))], spark)

    def matching(self, t: Triple) -> DataFrame:
        """The triples that a pattern's constants and repeated variables allow."""
        return self._matched(t)[0]

    def _matched(self, t: Triple) -> tuple[DataFrame, dict[str, tuple[Column, Kind]]]:
        df = self._rows()
        bound: dict[str, tuple[Column, Kind]] = {}

        def meet(x: Term, col: Column, kind: Kind) -> None:
            nonlocal df
            if isinstance(x, Var):
                if x.name in bound:
                    df = df.filter(V.as_term(*bound[x.name]) == V.as_term(col, kind))
                else:
                    bound[x.name] = (col, kind)
            elif kind.name == "iri":
                df = df.filter(col == x.value if isinstance(x, Iri) else F.lit(False))
            else:
                kind_no, lex, dt, lang = terms.row(x)
                df = df.filter((col["kind"] == kind_no) & (col["lex"] == lex) & col["dt"].eqNullSafe(F.lit(dt)) & col["lang"].eqNullSafe(F.lit(lang)))

        meet(t.p, F.col("p"), V.FULL_IRI)
        meet(t.s, F.col("s"), V.TERM_KIND)
        meet(t.o, F.col("o"), V.TERM_KIND)
        if isinstance(self.graph, Var):
            meet(self.graph, F.col("g"), V.FULL_IRI)
        return df, bound

    def _scan(self, t: Triple) -> S.Solutions:
        df, bound = self._matched(t)
        cols = [c.alias(S.column(n)) for n, (c, _) in bound.items()]
        # A graph is a set: a triple that stands in several graphs is one triple of their union.
        if not self.disjoint:
            df = df.select("p", "s", "o", *(["g"] if isinstance(self.graph, Var) else [])).distinct()
        return S.Solutions(df.select(*cols), {n: k for n, (_, k) in bound.items()})


def save(df: DataFrame, path: str, mode: str = "append") -> None:
    """Keep triples as Parquet, a folder a predicate, so that a pattern reads its own predicate only."""
    df.select("g", "s", "p", "o").write.mode(mode).partitionBy("p").parquet(path)


def open_store(spark: SparkSession, path: str | None = None, disjoint: bool = False) -> TripleStore:
    """The triples kept at a path; without one an empty store."""
    if path is None:
        return TripleStore(spark.createDataFrame([], SCHEMA), disjoint=True)
    return TripleStore(spark.read.schema(SCHEMA).parquet(path).select("g", "s", "p", "o"), disjoint=disjoint)
