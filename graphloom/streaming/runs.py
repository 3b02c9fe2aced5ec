"""Rows under a 64-bit key, kept as immutable runs that are merged by size.

A run is a folder of buckets by the key's low bits; a larger run has more buckets, so a
bucket holds about ``bucket_rows`` rows in any run, and inside it rows are in order of the key.  Looking up some keys therefore
reads one bucket a key and run, however much is kept, and Parquet's statistics skip within it.  Every batch
adds one run; ``fan`` runs of like size become one, so that a row is rewritten
a logarithmic number of times and a lookup meets a logarithmic number of runs.

What counts is said by manifests, one a batch, written whole: a batch that failed halfway leaves
folders that no manifest names, and runs again from the manifest before it.  A run goes two batches after the last manifest that named it.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources import store

#: Keys of a lookup that the driver learns of, to choose buckets; with more keys every bucket is read.
MOST_KEYS = 20_000
MOST_BUCKETS = 4096


@dataclass
class Run:
    path: str
    rows: int
    mask: int  # number of buckets less one
    sizes: dict[str, int]  # bucket → bytes

    def buckets(self, keys: list[int] | None) -> list[str]:
        return list(self.sizes) if keys is None else [b for b in dict.fromkeys(str(k & self.mask) for k in keys) if b in self.sizes]


@dataclass
class Runs:
    """``schema``: columns besides the key ``k``."""

    spark: SparkSession
    base: str
    schema: str
    bucket_rows: int = 200_000
    fan: int = 4
    bytes_read: int = field(default=0)

    @property
    def columns(self) -> str:
        return f"k long, {self.schema}"

    def _manifests(self) -> list[int]:
        return sorted(int(n[:-5]) for n, _ in store.children(self.spark, f"{self.base}/manifest") if n.endswith(".json"))

    def last(self) -> int:
        """The newest batch that was taken in; -1 before the first."""
        return max(self._manifests(), default=-1)

    def current(self) -> list[Run]:
        n = self.last()
        return self._load(n) if n >= 0 else []

    def _load(self, number: int) -> list[Run]:
        return [Run(**r) for r in json.loads(store.read_text(self.spark, f"{self.base}/manifest/{number:09d}.json"))]

    def write(self, rows: DataFrame, count: int) -> Run:
        """A run of (k, ...) rows, ``count`` of them."""
        buckets = 1 << min(MOST_BUCKETS.bit_length() - 1, max(0, math.ceil(count / self.bucket_rows) - 1).bit_length())
        path = f"{self.base}/run-{uuid.uuid4().hex}"
        # Rebalanced, so that a bucket with a hot key is written by several tasks.
        dealt = rows.withColumn("b", F.col("k").bitwiseAND(F.lit(buckets - 1))).hint("rebalance", "b").sortWithinPartitions("b", "k")
        dealt.write.partitionBy("b").parquet(path)
        return Run(path, count, buckets - 1, store.sizes(self.spark, path, "b="))

    def read(self, runs: list[Run], keys: DataFrame | None = None) -> DataFrame:
        """The rows of these keys (a column k), or of all; with many keys, of more keys than asked for."""
        wanted = None
        if keys is not None:
            found = keys.select("k").distinct().limit(MOST_KEYS + 1).collect()
            wanted = [r[0] for r in found] if len(found) <= MOST_KEYS else None
        chosen = [(r, b) for r in runs for b in r.buckets(wanted)]
        self.bytes_read += sum(r.sizes[b] for r, b in chosen)
        if not chosen:
            return self.spark.createDataFrame([], self.columns)
        out = self.spark.read.schema(self.columns).parquet(*(f"{r.path}/b={b}" for r, b in chosen))
        return out.filter(F.col("k").isin(wanted)) if wanted is not None and len(wanted) <= 500 else out

    def commit(self, number: int, runs: list[Run]) -> list[Run]:
        """Merge runs of like size, then say what counts from this batch on."""
        before = self._manifests()
        while tier := self._tier(runs):
            rows = sum(r.rows for r in tier)
            merged = self.write(reduce(DataFrame.unionByName, (self.spark.read.schema(self.columns).parquet(*(f"{r.path}/b={b}" for b in r.sizes)) for r in tier)), rows)
            runs = [r for r in runs if r not in tier] + [merged]
        store.write_text(self.spark, f"{self.base}/manifest/{number:09d}.json", json.dumps([r.__dict__ for r in runs]))
        if len(before) > 1:  # readers may still use the runs of the manifest before
            kept = {r.path for r in [*runs, *self._load(before[-1])]}
            for old in before[:-1]:
                for r in self._load(old):
                    if r.path not in kept:
                        store.delete(self.spark, r.path)
                store.delete(self.spark, f"{self.base}/manifest/{old:09d}.json")
        return runs

    def _tier(self, runs: list[Run]) -> list[Run]:
        tiers: dict[int, list[Run]] = {}
        for r in runs:
            tiers.setdefault(int(math.log(max(1, r.rows), self.fan)), []).append(r)
        return next((t for _, t in sorted(tiers.items()) if len(t) >= self.fan), [])
