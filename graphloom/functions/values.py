"""Typed solution columns: what a variable holds, and how types meet.

A variable over mapped tables keeps a native column, so that filters reach the
scan; a variable over loaded triples holds term structs.  Types meet at joins and
unions: equal ones stay, numbers widen to double, IRIs of different patterns
become full IRIs, everything else becomes terms.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.terms import XSD

#: Exact decimals have 19 digits before the point and 18 after it; what does not fit is an error, or a double where a literal or column says so.
DECIMAL = "decimal(37,18)"
NATIVE = {"str": "string", "int": "bigint", "dec": DECIMAL, "double": "double", "bool": "boolean", "time": "timestamp"}
NUMBERS = ("int", "dec", "double")
DATATYPE = {"str": XSD + "string", "int": XSD + "integer", "dec": XSD + "decimal", "double": XSD + "double", "bool": XSD + "boolean", "time": XSD + "dateTime"}


@dataclass(frozen=True)
class Kind:
    """``name``: iri (key after ``prefix``), term, or a native type; ``certain``: never unbound."""

    name: str
    prefix: str = ""
    certain: bool = True
    key: str = "string"  # of an iri: the key's SQL type

    def maybe(self) -> Kind:
        return replace(self, certain=False)

    def sure(self) -> Kind:
        return replace(self, certain=True)

    def like(self, other: Kind) -> bool:
        return (self.name, self.prefix, self.key) == (other.name, other.prefix, other.key)

    def sql(self) -> str:
        return self.key if self.name == "iri" else T.TERM.simpleString() if self.name == "term" else NATIVE[self.name]


TERM_KIND = Kind("term")
FULL_IRI = Kind("iri")


def of_sql(sql: str) -> Kind:
    """The kind of a table's column type."""
    if sql in ("tinyint", "smallint", "int", "bigint"):
        return Kind("int")
    if sql.startswith("decimal"):
        p, d = map(int, sql[8:-1].split(","))
        return Kind("dec" if d <= 18 and p - d <= 19 else "double")
    if sql in ("float", "double"):
        return Kind("double")
    return Kind({"boolean": "bool", "timestamp": "time", "timestamp_ntz": "time", "date": "time"}.get(sql, "str"))


def native(c: Column, kind: Kind) -> Column:
    return c.cast(NATIVE[kind.name]) if kind.name in NATIVE else c


def iri_text(c: Column, kind: Kind) -> Column:
    """The full IRI of an iri column."""
    return F.concat(F.lit(kind.prefix), c.cast("string")) if kind.prefix else c.cast("string")


def lexical(c: Column, kind: Kind) -> Column:
    """The text of a value, as STR gives it."""
    if kind.name == "term":
        return F.when(c["kind"] != T.BNODE, c["lex"])
    if kind.name == "iri":
        return iri_text(c, kind)
    if kind.name == "time":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if kind.name == "dec":
        return F.regexp_replace(c.cast(DECIMAL).cast("string"), r"\.?0+$", "")
    return c.cast("string")


def as_term(c: Column, kind: Kind) -> Column:
    if kind.name == "term":
        return c
    if kind.name == "iri":
        return T.make(T.IRI, iri_text(c, kind))
    return T.make(T.LITERAL, lexical(c, kind), DATATYPE[kind.name])


def numeric(c: Column, kind: Kind) -> Column:
    """A number, or null where the value is none."""
    if kind.name in NUMBERS:
        return c
    if kind.name == "term":
        return F.when(c["dt"].isin(*T.NUMERIC), c["lex"].try_cast("double"))
    return F.lit(None).cast("double")


def meet(a: Kind, b: Kind) -> Kind:
    """A kind that holds both."""
    if a.like(b):
        return a
    if a.name == b.name == "iri":
        return FULL_IRI if a.prefix != b.prefix else replace(a, key="string")
    if a.name in NUMBERS and b.name in NUMBERS:
        return Kind(max(a.name, b.name, key=NUMBERS.index))
    return TERM_KIND


def convert(c: Column, kind: Kind, to: Kind) -> Column:
    if kind.like(to):
        return c
    if to.name == "term":
        return as_term(c, kind)
    if to.name == "iri":
        return iri_text(c, kind) if not to.prefix else c.cast(to.key)
    return c.cast(NATIVE[to.name])
