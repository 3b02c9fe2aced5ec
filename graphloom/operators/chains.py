"""Long chains over whole-numbered keys: what lies within a block of keys is walked in one task.

Resources that were numbered in order follow one another within a block, and only the edges from block to block are
left for joins.  A block holds at most ``BLOCK`` rows, since each resource has one way on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
BLOCK = 1 << BITS
#: Rows a block that make a task's work worth its call, and an edge between blocks.
LEAST_ROWS, LEAST_WITHIN = 500, 4


def block(key: Column) -> Column:
    return F.shiftright(key.cast("bigint"), BITS)


def dense(pairs: DataFrame) -> bool:
    """Whether (at, to) mostly stay within blocks that hold many."""
    at, to = map(F.col, pairs.columns)
    by = pairs.groupBy(block(at).alias("b")).agg(F.count("*").alias("n"), F.count_if(block(at) != block(to)).alias("out"))
    blocks, rows, out = by.agg(F.count("*"), F.sum("n"), F.sum("out")).first()
    return bool(rows) and rows >= LEAST_ROWS * blocks and rows >= LEAST_WITHIN * out


def entries(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """Where walks begin: the starts, and what another block leads to."""
    a, b = pairs.columns
    across = pairs.filter(block(F.col(a)) != block(F.col(b))).select(F.col(b).alias(a))
    return starts.unionByName(across).distinct()


def across(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """(at, to): from each mark to the first resource of another block that its walk comes to."""
    a, b = pairs.columns
    kind = pairs.schema[a].dataType.simpleString()
    return _by_block(pairs, marks).applyInArrow(_leave, "a bigint, b bigint").select(F.col("a").cast(kind).alias(a), F.col("b").cast(kind).alias(b))


def within(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The marks and all that their walks come to before they leave their block, each once."""
    a = pairs.columns[0]
    kind = pairs.schema[a].dataType.simpleString()
    return _by_block(pairs, marks).applyInArrow(_stay, "a bigint").select(F.col("a").cast(kind).alias(a))


def _by_block(pairs: DataFrame, marks: DataFrame):
    a, b = pairs.columns
    rows = pairs.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))
    both = rows.unionByName(marks.select(F.col(a).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b")))
    return both.groupBy(block(F.col("a")).alias("block"))


def _rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows by key, the index of the row that each leads to or -1, the marks and their rows' indexes or -1."""
    mark = t["b"].is_null().to_numpy()
    key = t["a"].to_numpy()
    at, to = key[~mark], t["b"].drop_null().to_numpy()
    order = np.argsort(at, kind="stable")
    at, to, marks = at[order], to[order], np.unique(key[mark])

    def index(x: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.full(len(x), -1)
        i = np.minimum(np.searchsorted(at, x), len(at) - 1)
        return np.where(at[i] == x, i, -1)

    return at, to, index(to), marks, index(marks)


def _leave(t: pa.Table) -> pa.Table:
    at, to, on, marks, own = _rows(t)
    marks, own = marks[own >= 0], own[own >= 0]
    last = np.where(on >= 0, on, np.arange(len(at)))
    for _ in range(BITS + 1):
        last = last[last]
    ends = last[own]
    out = (on[ends] < 0) & (to[ends] >> BITS != marks >> BITS)  # else it ends here, or goes round
    return pa.table({"a": pa.array(marks[out], pa.int64()), "b": pa.array(to[ends][out], pa.int64())})


def _stay(t: pa.Table) -> pa.Table:
    at, to, jump, marks, own = _rows(t)
    hit, ends = np.zeros(len(at), bool), jump < 0
    hit[own[own >= 0]] = True
    for _ in range(BITS + 1):
        some = hit & (jump >= 0)
        hit[jump[some]] = True
        jump = np.where(jump >= 0, jump[jump], -1)
    last = to[hit & ends]
    here = last[last >> BITS == marks[0] >> BITS] if len(marks) else last[:0]
    return pa.table({"a": pa.array(np.unique(np.concatenate([at[hit], here, marks])), pa.int64())})
