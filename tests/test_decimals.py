"""Exact decimals: promotion, aggregates, casts, what does not fit."""

from decimal import Decimal

import pytest

from graphloom import tables
from graphloom.plans.compiler import Compiler
from graphloom.plans.parser import parse
from graphloom.session import Session
from graphloom.sources.mapping import Mapping, TableClass
from graphloom.sources.triples import TripleStore, frame


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        ("0.1 + 0.2", "0.3"), ("6 / 3", "2"), ("1 / 3", "0.333333333333333333"), ("1.1 * 1.1", "1.21"), ("5 - 0.5", "4.5"), ("-(0.25)", "-0.25"), ("0.1 + 1e0", "1.1"), ("1 / 0", None), ('xsd:decimal("1.50")', "1.5"), ("xsd:decimal(1e-3)", "0.001"),
        ("xsd:integer(2.9)", "2"), ("ROUND(2.5)", "3"), ("ROUND(-2.5)", "-2"), ("CEIL(2.1)", "3"), ("ABS(-0.5)", "0.5"), ("DATATYPE(6 / 3)", "http://www.w3.org/2001/XMLSchema#decimal"), ("DATATYPE(0.5 + 1e0)", "http://www.w3.org/2001/XMLSchema#double"),
        ("IF(true, 1, 2.5)", "1"), ("COALESCE(1 / 0, 0.5)", "0.5"), ("9999999999999999999.0 + 1", None), ("0.000000000000000001 * 1", "0.000000000000000001"), ("isNumeric(0.5)", "true"), ('xsd:decimal("x")', None),
    ],
)
def test_promotion(spark, expr, want):
    assert Compiler(spark, TripleStore(frame(spark, []))).select(parse(f"SELECT (STR({expr}) AS ?x) {{}}")).first()[0] == want


@pytest.mark.parametrize(("expr", "want"), [("0.1 + 0.2 = 0.3", True), ("1 = 1.0", True), ("0.5 < 1", True), ("0.1 = 1e-1", True), ("2 IN (1.0, 2.0)", True), ("6 / 3 = 2", True), ("sameTerm(6 / 3, 2)", False)])
def test_comparison(spark, expr, want):
    assert Compiler(spark, TripleStore(frame(spark, []))).select(parse(f"SELECT ({expr} AS ?x) {{}}")).first()[0] is want


def test_results_show_doubles_unless_asked(spark):
    s = tables.session(spark, "/root/testdata/sf0.001")
    ask = "SELECT (AVG(?k) AS ?a) (SUM(xsd:decimal(?b)) AS ?s) (SUM(DISTINCT ?z * 0.5) AS ?h) WHERE { ?c t:c_custkey ?k ; t:c_acctbal ?b ; t:c_nationkey ?z }"
    plain, exact = s.sparql(ask).first(), None
    s.decimals = True
    exact = s.sparql(ask).first()
    rows = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").collect()
    keys, sums = [r.c_custkey for r in rows], sum(Decimal(str(r.c_acctbal)) for r in rows)
    assert isinstance(plain.a, float) and exact.s == sums and plain.s == float(sums)
    assert exact.a == (Decimal(sum(keys)) / len(keys)).quantize(Decimal(10) ** -18) and exact.h == Decimal(sum({r.c_nationkey for r in rows})) / 2


def test_values_unions_and_columns(spark):
    df = spark.createDataFrame([(1, Decimal("0.10"), 0.5), (2, Decimal("2.50"), 2.5)], "id long, price decimal(10,2), x double")
    own = TableClass("urn:C", "c", "id", "urn:c/", {"urn:e#price": "price", "urn:e#x": "x"}, {})
    s = Session(spark, Mapping({own.iri: own}, lambda _: df), prefixes={"": "urn:e#"}, decimals=True)
    assert [r.s for r in s.sparql("SELECT ?s { ?s :price 0.1 }").collect()] == ["urn:c/1"]
    assert [r.s for r in s.sparql("SELECT ?s { ?s :x 2.5 }").collect()] == ["urn:c/2"]
    assert sorted(r.v for r in s.sparql("SELECT ?v { { ?s :price ?v } UNION { VALUES ?v { 3 0.25 } } }").collect()) == [Decimal("0.1"), Decimal("0.25"), Decimal("2.5"), 3]
    assert s.sparql("SELECT (SUM(?v) AS ?t) { VALUES ?v { 0.1 0.2 1 } }").first().t == Decimal("1.3")
    assert s.sparql("SELECT (SUM(?v) AS ?t) (AVG(?v) AS ?a) { ?s :price ?v FILTER(?v > 9) }").first() == (0, 0)
