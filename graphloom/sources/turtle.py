"""Turtle and N-Triples: reading on the driver, reading in parallel, writing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.terms import RDF_TYPE, BNode, Iri, Literal, Term, Var
from graphloom.plans.parser import Parser, SparqlError
from graphloom.sources.triples import SCHEMA


def parse_turtle(text: str, base: str = "") -> tuple[list[tuple[Term, Term, Term]], dict[str, str]]:
    """(triples, prefixes) of a Turtle document; N-Triples is a part of Turtle."""
    p = Parser(text, {}, base)
    p.prefixes = {}
    out: list = []
    while p.peek()[0] != "end":
        word = p.peek()[1]
        if word in ("@prefix", "@base") or p.is_("PREFIX", "BASE"):
            p.i += 1
            if word.lower().lstrip("@") == "base":
                p.base = p.resolve(p.take("iri")[1:-1])
            else:
                name = p.take("pname")
                if not name.endswith(":"):
                    raise SparqlError(f"bad prefix {name!r}")
                p.prefixes[name[:-1]] = p.resolve(p.take("iri")[1:-1])
            if word.startswith("@"):
                p.expect(".")
            continue
        p.triples(out, in_template=True)
        if p.peek()[0] != "end":
            p.expect(".")
    for t in out:
        if any(isinstance(x, Var) for x in t) or not isinstance(t.p, Iri) or isinstance(t.s, Literal):
            raise SparqlError(f"not a triple: {t}")
    return [tuple(t) for t in out], p.prefixes


def _short(t: Term, prefixes: dict[str, str]) -> str:
    if isinstance(t, Iri):
        for k, v in prefixes.items():
            local = t.value.removeprefix(v)
            if local != t.value and local.replace("_", "").replace("-", "").isalnum():
                return f"{k}:{local}"
    if isinstance(t, Literal) and t.dt:
        return f"{Literal(t.lex)}^^{_short(Iri(t.dt), prefixes)}"
    return str(t)


def write_turtle(triples: Iterable[tuple[Term, Term, Term]], prefixes: dict[str, str]) -> str:
    """A document that groups triples by subject."""
    triples = list(triples)
    used = {k: v for k, v in prefixes.items() if any(isinstance(x, Iri) and x.value.startswith(v) or isinstance(x, Literal) and (x.dt or "").startswith(v) for t in triples for x in t)}
    by: dict[Term, list[tuple[Term, Term]]] = {}
    for s, p, o in triples:
        by.setdefault(s, []).append((p, o))
    lines = [f"@prefix {k}: <{v}> ." for k, v in sorted(used.items())] + [""]
    for s, own in by.items():
        body = " ;\n    ".join(f"{'a' if p == Iri(RDF_TYPE) else _short(p, used)} {_short(o, used)}" for p, o in own)
        lines.append(f"{_short(s, used)} {body} .")
    return "\n".join(lines) + "\n"


def skolemise(triples: Iterable[tuple[Term, Term, Term]], base: str = "http://bnodes/") -> list[tuple[Term, Term, Term]]:
    """Blank nodes as IRIs, for exchange between services."""
    f = lambda x: Iri(base + x.label) if isinstance(x, BNode) else x
    return [(f(s), p, f(o)) for s, p, o in triples]


def deskolemise(triples: Iterable[tuple[Term, Term, Term]], base: str = "http://bnodes/") -> list[tuple[Term, Term, Term]]:
    f = lambda x: BNode(x.value.removeprefix(base)) if isinstance(x, Iri) and x.value.startswith(base) else x
    return [(f(s), p, f(o)) for s, p, o in triples]


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for g, text in zip(pdf["g"], pdf["value"], strict=True):
            for s, p, o in parse_turtle(text)[0]:
                rows.append((g, terms.row(s), p.value, terms.row(o)))
        names = ("kind", "lex", "dt", "lang")
        yield pd.DataFrame([{"g": g, "s": dict(zip(names, s, strict=True)), "p": p, "o": dict(zip(names, o, strict=True))} for g, s, p, o in rows], columns=["g", "s", "p", "o"])


_NTRIPLE = r'''^\s*(?:<([^<>"{}|^`\\]*)>|_:([^\s<"]+))\s*<([^<>"{}|^`\\]*)>\s*(?:<([^<>"{}|^`\\]*)>|_:([^\s<"]+?)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'''


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(g, s, p, o) of N-Triples files, matched line by line in parallel; g is the file.

    Blank nodes are told apart by file.  A line without escapes in it is taken apart
    by one pattern, others by the parser; a line that is no triple is an error.
    """
    lines = spark.read.text(path).withColumn("g", F.input_file_name()).filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    plain = F.col("value").rlike(_NTRIPLE) & ~F.contains("value", F.lit("\\"))
    part = lambda i: F.regexp_extract("value", _NTRIPLE, i)
    s = F.when(part(2) != "", terms.make(terms.BNODE, part(2))).otherwise(terms.make(terms.IRI, part(1)))
    literal = terms.make(terms.LITERAL, part(6), F.when(part(7) != "", part(7)).when(part(8) == "", F.lit(terms.XSD + "string")), F.when(part(8) != "", F.lower(part(8))))
    o = F.when(part(5) != "", terms.make(terms.BNODE, part(5))).when(part(4) != "", terms.make(terms.IRI, part(4))).otherwise(literal)
    matched = lines.filter(plain).select("g", s.alias("s"), part(3).alias("p"), o.alias("o"))
    parsed = lines.filter(~plain).select("g", "value").mapInPandas(_lines, SCHEMA)
    return _apart(matched.unionByName(parsed))


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(g, s, p, o) of Turtle files, a file a row; blank nodes are told apart by file."""
    files = spark.read.text(path, wholetext=True).withColumn("g", F.input_file_name()).select("g", "value")
    return _apart(files.mapInPandas(_lines, SCHEMA))


def _apart(out: DataFrame) -> DataFrame:
    """Blank nodes by file."""
    own = lambda c: F.when(F.col(f"{c}.kind") == terms.BNODE, F.col(c).withField("lex", F.concat(F.sha1("g"), F.lit("_"), F.col(f"{c}.lex")))).otherwise(F.col(c))
    return out.select("g", own("s").alias("s"), "p", own("o").alias("o"))
