"""The registered queries of vocabulary, plans, documents and caches against their SQL, and what their plans must not hold."""

import collections
import os
import re

import pytest

from graphloom import linked_queries, queries
from graphloom.sources import store
from graphloom.sources.turtle import parse_turtle, read_ntriples

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def same(spark, duck, query, sql):
    df = query(spark, SF)
    names = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert collections.Counter(map(tuple, df.select(*names).collect())) == collections.Counter(want)


@pytest.mark.parametrize("name", sorted(linked_queries.QUERIES))
def test_linked_queries_equal_sql(spark, duck, name):
    same(spark, duck, *linked_queries.QUERIES[name])


UNSURE = ["optional_maybe_unbound", "minus_maybe_unbound", "exists_maybe_unbound", "not_exists_maybe_unbound", "values_undef", "join_maybe_unbound"]


@pytest.mark.parametrize("name", [*UNSURE, "optional_exists_filter", "optional_not_exists_or", "vocab_cycles", "vocab_domains"])
def test_queries_equal_sql(spark, duck, name):
    same(spark, duck, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", UNSURE)
def test_unbound_variables_do_not_hide_equal_keys(spark, name):
    """No join tests "equal or null": bound rows meet by their keys, and products stand only where a row binds nothing shared."""
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("\n") if re.search("Join|CartesianProduct", x)]
    assert joins and not [x for x in joins if " OR " in x]
    if name in ("minus_maybe_unbound", "values_undef"):
        assert not [x for x in joins if "NestedLoop" in x or "Cartesian" in x]


def test_ntriples_equal_the_parser(spark, tmp_path):
    lines = [
        '<urn:a> <urn:p> <urn:b> .', '_:x1 <urn:p> _:x2.', '<urn:a> <urn:p> "plain" .', '<urn:a> <urn:p> "" . # end', '<urn:a>\t<urn:p>\t"1"^^<http://www.w3.org/2001/XMLSchema#integer> .', '<urn:a> <urn:p> "é 😀 . <x>"@en-GB .',
        '<urn:a> <urn:p> "a \\"quoted\\" line\\n\\u00e9" .', "# only a comment", "", "<urn:a> <urn:p> _:x.y .",
    ]
    for i in range(2):
        (tmp_path / f"{i}.nt").write_text("\n".join(lines) + "\n")
    got = read_ntriples(spark, f"file://{tmp_path}").collect()
    from graphloom.functions import terms

    def own(r):
        return (r.kind, r.lex.partition("_")[2] if r.kind == terms.BNODE else r.lex, r.dt, r.lang)

    want = collections.Counter((terms.row(s), p.value, terms.row(o)) for _ in range(2) for s, p, o in parse_turtle("\n".join(lines))[0])
    assert collections.Counter((own(r.s), r.p, own(r.o)) for r in got) == want
    nodes = {x.lex for r in got for x in (r.s, r.o) if x.kind == terms.BNODE}
    assert len(nodes) == 6
    (tmp_path / "2.nt").write_text("not a triple\n")
    with pytest.raises(Exception):
        read_ntriples(spark, f"file://{tmp_path}").collect()


def test_a_local_folder_is_refused_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Away:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        store.shared_dir(Away())


def test_text_is_replaced_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/x.json"
    for text in ("one", "two"):
        store.write_text(spark, path, text)
        assert store.read_text(spark, path) == text
    assert [n for n, _ in store.children(spark, f"file://{tmp_path}") if not n.startswith(".")] == ["x.json"]
