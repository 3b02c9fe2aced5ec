"""RDF terms on the driver and as Spark columns.

In a DataFrame a generic term is a struct (kind, lex, dt, lang); equality of
structs is equality of terms.  Kinds are numbered in the order in which SPARQL
sorts them: blank nodes, IRIs, literals, with null (unbound) before all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
RDF_TYPE = RDF + "type"
BNODE, IRI, LITERAL = 1, 2, 3
NUMERIC = tuple(XSD + n for n in ("integer", "decimal", "float", "double", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong"))

TERM = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("lex", T.StringType()), T.StructField("dt", T.StringType()), T.StructField("lang", T.StringType())])


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class Iri:
    value: str

    def __str__(self) -> str:
        return f"<{self.value}>"


@dataclass(frozen=True)
class BNode:
    label: str

    def __str__(self) -> str:
        return f"_:{self.label}"


@dataclass(frozen=True)
class Literal:
    lex: str
    dt: str | None = None
    lang: str | None = None

    def __str__(self) -> str:
        text = '"' + self.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
        return f"{text}@{self.lang}" if self.lang else f"{text}^^<{self.dt}>" if self.dt and self.dt != XSD + "string" else text

    def native(self) -> int | float | bool | str | None:
        """The Python value of a literal of a known type; None if its text is not of that type."""
        try:
            if self.dt in (None, XSD + "string"):
                return self.lex
            if self.dt == XSD + "boolean":
                return {"true": True, "1": True, "false": False, "0": False}.get(self.lex)
            if self.dt in (XSD + "double", XSD + "float"):
                return float(self.lex.replace("INF", "inf"))
            if self.dt == XSD + "decimal":
                return float(self.lex)
            if self.dt in NUMERIC:
                return int(self.lex)
        except ValueError:
            return None
        return self.lex


Term = Var | Iri | BNode | Literal

_N3 = re.compile(r"""<([^<>"{}|^`\\\x00-\x20]*)>|_:([A-Za-z0-9_](?:[A-Za-z0-9_.-]*[A-Za-z0-9_-])?)|"((?:[^"\\\n\r]|\\.)*)"(?:@([a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|\^\^<([^<>]*)>)?""")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text)


def parse_n3(text: str) -> Term:
    """A term written as in N-Triples."""
    m = _N3.fullmatch(text.strip())
    if not m:
        raise ValueError(f"not a term: {text!r}")
    if m[1] is not None:
        return Iri(unescape(m[1]))
    if m[2] is not None:
        return BNode(m[2])
    return Literal(unescape(m[3]), m[5], m[4].lower() if m[4] else None)


def row(term: Term) -> tuple[int, str, str | None, str | None]:
    """A term as the struct's fields."""
    if isinstance(term, Iri):
        return IRI, term.value, None, None
    if isinstance(term, BNode):
        return BNODE, term.label, None, None
    return LITERAL, term.lex, None if term.lang else term.dt or XSD + "string", term.lang


def unrow(r: tuple | T.Row | None) -> Term | None:
    if r is None:
        return None
    kind, lex, dt, lang = r
    return Iri(lex) if kind == IRI else BNode(lex) if kind == BNODE else Literal(lex, None if lang or dt == XSD + "string" else dt, lang)


def lit(term: Term) -> Column:
    """A constant term as a struct column."""
    kind, lex, dt, lang = row(term)
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).cast("byte").alias("kind"), F.lit(lex).alias("lex"), (F.lit(dt) if dt else none).alias("dt"), (F.lit(lang) if lang else none).alias("lang"))


def make(kind: int, lex: Column, dt: Column | str | None = None, lang: Column | None = None) -> Column:
    """A struct column from a text column; null where the text is null."""
    none = F.lit(None).cast("string")
    dt = F.lit(dt) if isinstance(dt, str) else none if dt is None else dt
    return F.when(lex.isNotNull(), F.struct(F.lit(kind).cast("byte").alias("kind"), lex.alias("lex"), dt.alias("dt"), (none if lang is None else lang).alias("lang")))


def n3(term: Column) -> Column:
    """A struct column as N-Triples text."""
    text = term["lex"]
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.concat(F.lit('"'), text, F.lit('"'))
    typed = F.when(term["lang"].isNotNull(), F.concat(text, F.lit("@"), term["lang"])).when(term["dt"] == XSD + "string", text).otherwise(F.concat(text, F.lit("^^<"), term["dt"], F.lit(">")))
    return F.when(term["kind"] == IRI, F.concat(F.lit("<"), term["lex"], F.lit(">"))).when(term["kind"] == BNODE, F.concat(F.lit("_:"), term["lex"])).otherwise(typed)
