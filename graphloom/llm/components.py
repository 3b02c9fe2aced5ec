"""Connected components of an edge table by alternating large and small stars.

Every round is two joins on the node and a table in the shared folder; the
number of rounds grows with the logarithm of the longest chain.  Smallest
labels are found by aggregates that combine before the shuffle, and the joins
are plain equi-joins, so that a node with very many edges is split by adaptive
execution.  Links are never gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of (a, b) edges; component is the smallest node reachable.

    Self-loops, repeated edges and either direction are allowed; an empty
    table gives an empty table.  Null ends are dropped.
    """
    ends = edges.filter("a is not null and b is not null and a <> b")
    e = scratch.save(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    before, step = _mark(e), 0
    while before[0]:
        step += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = scratch.save(small.select("e.*").filter("u > v").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        after = _mark(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(e: DataFrame) -> tuple[int, int]:
    """Number of edges and a digest of them."""
    row = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])
