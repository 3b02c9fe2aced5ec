"""Results as text: SPARQL JSON, quads, resources."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions import values as V
from graphloom.functions.terms import XSD
from graphloom.operators.solutions import Solutions
from graphloom.plans.compiler import Compiler
from graphloom.plans.parser import parse

DOT = "·"


def binding_column(s: Solutions, var: str):
    """A value as a binding of the SPARQL JSON results format."""
    t = V.as_term(s.col(var), s.kinds[var])
    kind = F.when(t["kind"] == T.IRI, "uri").when(t["kind"] == T.BNODE, "bnode").when(t["dt"].isNotNull() & (t["dt"] != XSD + "string"), "typed-literal").otherwise("literal")
    return F.when(t.isNotNull(), F.struct(kind.alias("type"), t["lex"].alias("value"), F.when(t["dt"] != XSD + "string", t["dt"]).alias("datatype"), t["lang"].alias("xml:lang")))


def json_rows(compiler: Compiler, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(binding): one JSON object for each solution of a SELECT query."""
    q = parse(text, prefixes)
    out = compiler.compile(q.part)
    return out.df.select(F.to_json(F.struct(*(binding_column(out, v).alias(v) for v in q.vars))).alias("binding"))


def json_lines(compiler: Compiler, text: str, prefixes: dict[str, str] | None = None) -> Iterator[str]:
    """The document in pieces, row by row."""
    q = parse(text, prefixes)
    names = ", ".join(f'"{v}"' for v in q.vars)
    yield f'{{"head": {{"vars": [{names}]}}, "results": {{"bindings": ['
    first = True
    for r in json_rows(compiler, text, prefixes).toLocalIterator():
        yield r[0] if first else ", " + r[0]
        first = False
    yield "]}}"


def quad_text(quads: DataFrame, style: str = "quad", prefixes: dict[str, str] | None = None) -> DataFrame:
    """(value): quads as lines; styles n3 (triples), quad (with the pattern), quad-min (with prefixes)."""
    s, o = T.n3(F.col("s")), T.n3(F.col("o"))
    p = F.concat(F.lit("<"), F.col("p"), F.lit(">"))
    if style == "n3":
        return quads.select(F.concat_ws(" ", s, p, o, F.lit(".")).alias("value")).distinct()
    if style == "quad-min":

        def short(c):
            for k, iri in sorted((prefixes or {}).items(), key=lambda x: -len(x[1])):
                end = F.substring(c, F.lit(len(iri) + 2), F.length(c) - (len(iri) + 2))
                c = F.when(F.startswith(c, F.lit("<" + iri)), F.concat(F.lit(k + ":"), end)).otherwise(c)
            return c

        s, p, o = short(s), short(p), short(o)
    elif style != "quad":
        raise ValueError(style)
    return quads.select(F.concat_ws(DOT, "tp", s, p, o).alias("value"))


def parse_quads(lines: DataFrame) -> DataFrame:
    """(tp, s, p, o) from lines of style quad."""
    parts = F.split("value", DOT, -1)
    term = lambda c: (
        F.when(F.startswith(c, F.lit("<")), T.make(T.IRI, F.substring(c, F.lit(2), F.length(c) - 2)))
        .when(F.startswith(c, F.lit("_:")), T.make(T.BNODE, F.substring(c, F.lit(3), F.length(c))))
        .otherwise(_literal(c))
    )
    return lines.select(parts[0].alias("tp"), term(parts[1]).alias("s"), F.substring(parts[2], F.lit(2), F.length(parts[2]) - 2).alias("p"), term(F.array_join(F.slice(parts, 4, F.size(parts)), DOT)).alias("o"))


def _literal(c):
    pattern = r'(?s)^"(.*)"(?:@([a-z]+(?:-[a-z0-9]+)*)|\^\^<([^<>]*)>)?$'
    lex, lang, dt = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    lex = F.replace(lex, F.lit("\\\\"), F.lit("\u0001"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\u0001", "\\")):
        lex = F.replace(lex, F.lit(a), F.lit(b))
    return T.make(T.LITERAL, lex, F.when(lang != "", F.lit(None)).when(dt == "", F.lit(XSD + "string")).otherwise(dt), F.when(lang != "", lang))


def remote_quads(spark: SparkSession, url: str, query: str) -> DataFrame:
    """(tp, s, p, o): the fragment that another engine's service has for a query."""
    from graphloom.service import Client

    return parse_quads(spark.createDataFrame([(x,) for x in Client(url).fragment(query)], "value string"))
