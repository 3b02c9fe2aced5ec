"""Nearest neighbours of a query set by a block matrix join.

Vectors are stored as 8-bit numbers with a scale of their own and the exact norm
of what rounding lost.  Queries and candidates are dealt into blocks of bounded
size; a cell is one block of each.  In a cell a matrix product of the 8-bit
numbers gives every distance up to the two norms of rounding error: a pair
survives if its lower bound is not above the query's k-th best, and only
survivors are computed from the original vectors in double precision.  Each cell
keeps k for a query in a heap; the cells' heaps are merged by rank.

The result is exact: bounds decide what is computed, never what is returned; where a
bound is no number, the pair is computed.  Components of any finite size are scaled
before they are squared.
The work is the number of queries times the number of vectors by nature; a block
of candidates travels once for each block of queries.

Defined results: distance is Euclidean, ties go to the smaller id.  Vectors that
are null, empty, zero, or hold null or non-finite components take no part; only
vectors of equal length are compared; a row is not its own neighbour, nor is one
of the same id.  A query has as many neighbours as there are, up to k; rows that
repeat an id are candidates each, and queries of one id with different vectors are answered each.  A distance above the largest double is infinite.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 16384
TILE = 1024


def usable(vector: Column) -> Column:
    """No null, no non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(8-bit rows, scale of each, norm of each rounding error)."""
    scale = np.abs(v).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(v / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((v - q * scale[:, None]) ** 2).sum(axis=1))


def bounds(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances between two quantised sets."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    kind = np.float32 if qa.shape[1] <= 1024 else np.float64  # products of 8-bit numbers are then exact
    dot = qa.astype(kind) @ qb.astype(kind).T
    na, nb = ((q.astype(np.float64) ** 2).sum(axis=1) * s**2 for q, s in ((qa, sa), (qb, sb)))
    square = na[:, None] + nb[None, :] - 2 * sa[:, None] * sb[None, :] * dot
    near = np.sqrt(np.maximum(square, 0))
    slack = ea[:, None] + eb[None, :] + 1e-6 * (1 + near)
    return near - slack, near + slack


def _distances(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components summed in order."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        diff = rows - x
        most = np.abs(diff).max(axis=1)
        out = np.sqrt(np.cumsum(diff**2, axis=1)[:, -1])
        odd = np.flatnonzero((most > 1e150) | (most < 1e-150) & (most > 0))  # squares would not fit
        if len(odd):
            scaled = diff[odd] / most[odd, None]
            out[odd] = np.where(np.isfinite(most[odd]), most[odd] * np.sqrt(np.cumsum(scaled**2, axis=1)[:, -1]), np.inf)
        return out


def best_in_cell(qid: np.ndarray, qv: np.ndarray, cid: np.ndarray, cv: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k nearest candidates as (distance, id), nearest first."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]  # of (-distance, -id): the worst is first
    most = max(np.abs(qv).max(), np.abs(cv).max())
    unit = most if most > 1e100 else 1.0  # bounds are in this unit
    queries = quantise(qv / unit)
    for j in range(0, len(cid), TILE):
        ids, rows = cid[j : j + TILE], cv[j : j + TILE]
        tile = quantise(rows / unit)
        for i in range(0, len(qid), TILE):
            low, high = bounds(tuple(x[i : i + TILE] for x in queries), tile)
            own = qid[i : i + TILE, None] == ids[None, :]
            low[own] = high[own] = np.inf
            limit = np.partition(high, min(k, high.shape[1]) - 1, axis=1)[:, min(k, high.shape[1]) - 1]
            for r in range(len(low)):
                heap = heaps[i + r]
                worst = min(limit[r], -heap[0][0] / unit * (1 + 1e-12) if len(heap) == k else np.inf)
                keep = np.flatnonzero(~(low[r] > worst) & ~own[r])
                if not len(keep):
                    continue
                for d, c in zip(_distances(qv[i + r], rows[keep]).tolist(), ids[keep].tolist(), strict=True):
                    if len(heap) < k:
                        heapq.heappush(heap, (-d, -c))
                    elif (-d, -c) > heap[0]:
                        heapq.heapreplace(heap, (-d, -c))
    return [sorted((-d, -c) for d, c in h) for h in heaps]


def _table(t: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return t.column("id").to_numpy(), flat.astype(np.float64).reshape(-1, size)


def _cell(k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    names = ["query_id", "body", "vec_id", "score"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, float]] = []
        if left.num_rows and right.num_rows:
            size = key[0].as_py()
            (qid, qv), (cid, cv) = _table(left, size), _table(right, size)
            for q, body, best in zip(qid.tolist(), left.column("body").to_pylist(), best_in_cell(qid, qv, cid, cv, k), strict=True):
                out += [(q, body, c, d) for d, c in best]
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=names)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of each row where ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    across = max(-(-n // CANDIDATE_BLOCK), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TILE)), 1)
    down = max(-(-asking // QUERY_BLOCK), 1)
    deal = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = rows.filter("asks").withColumn("body", F.xxhash64("v")).dropDuplicates(["id", "body"])
    queries = queries.select("dim", deal(down).alias("down"), every(across).alias("across"), "id", "body", "v")
    candidates = rows.select("dim", every(down).alias("down"), deal(across).alias("across"), "id", "v")
    cell = ["dim", "down", "across"]
    found = queries.groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInArrow(_cell(k), "query_id long, body long, vec_id long, score double")
    rank = F.expr("row_number() over (partition by query_id, body order by score, vec_id)")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
