"""Functional relations: blocks of keys walked in one task, and tables of a loop with sizes of their own."""

import random

import pytest

from graphloom.functions.values import Kind
from graphloom.operators import chains
from graphloom.operators.solutions import Solutions
from graphloom.operators.traversal import Traversal
from graphloom.operators.vocabulary import Vocabulary
from graphloom.sources.mapping import Mapping, TableClass

KIND = Kind("iri", "urn:e/", True, "bigint")


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("blocks", [True, False])
def test_walks_equal_plain_ones(spark, seed, blocks, monkeypatch):
    """Trees, rings and ends within blocks and across them; keys below zero; starts without a way on."""
    rng = random.Random(seed)
    key = lambda: (rng.randrange(-2, 3) << chains.BITS) + rng.choice([0, chains.BLOCK - 1, *range(1, 40)])
    near = lambda x: (x >> chains.BITS << chains.BITS) + rng.randrange(40)
    on = {x: near(x) if rng.random() < 0.7 else key() for x in (key() for _ in range(150))}
    starts = {key() for _ in range(3)} | {7 << chains.BITS}
    want, at = set(starts), set(starts)
    while at:
        at = {on[x] for x in at if x in on} - want
        want |= at
    monkeypatch.setattr(chains, "dense", lambda _: blocks)
    pairs = Solutions(spark.createDataFrame([*on.items(), (None, 5)], "v_at long, v_to long"), {"at": KIND, "to": KIND})
    t = Traversal(spark, None, Vocabulary())
    got = t._doubled(Solutions(spark.createDataFrame([(x,) for x in starts], "v_at long"), {"at": KIND}), pairs)
    assert sorted(r[0] for r in got.df.collect()) == sorted(want)


@pytest.mark.parametrize("key", ["id", "concat('n', id)"])
def test_sizes_do_not_double_their_digits(spark, key):
    """What Spark takes a table of a round for is about its size; products of sizes filled the driver on long chains."""
    n = 20_000
    own = TableClass("urn:E", "e", key, "urn:e/", {}, {"urn:next": (key.replace("id", "id + 1"), "urn:E")})
    t = Traversal(spark, Mapping({own.iri: own}, lambda _: spark.range(n)), Vocabulary())
    kind = Kind("iri", own.prefix, True, "bigint" if key == "id" else "string")
    got = t.fixpoint(Solutions(spark.range(1).selectExpr(f"{key} as v_at"), {"at": kind}), ["urn:next"]).df
    assert got.count() == got.distinct().count() == n + 1
    assert int(str(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10**9


def test_a_chain_in_order_is_walked_in_blocks(spark):
    pairs = spark.range(3 * chains.BLOCK).selectExpr("id AS v_at", "id + 1 AS v_to")
    assert chains.dense(pairs) and not chains.dense(pairs.selectExpr("v_at * 1000 AS v_at", "v_to * 1000 AS v_to"))
    assert not chains.dense(pairs.selectExpr("v_at", f"(v_to * {chains.BLOCK + 1}) % {3 * chains.BLOCK} AS v_to")) and not chains.dense(pairs.limit(0))
    ends = chains.across(pairs, chains.entries(pairs, spark.range(1).selectExpr("id AS v_at")))
    assert sorted(map(tuple, ends.collect())) == [(i * chains.BLOCK, (i + 1) * chains.BLOCK) for i in range(3)]
