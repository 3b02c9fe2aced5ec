"""Shards with size-tiered compaction and versioned manifests.

A store is a folder of immutable Parquet files and of a log.  ``append`` writes an
arrival as small shards; ``compact`` merges shards of similar size into files near
a target; both then commit the next version, a manifest that names the shards that
it adds and those that it replaces.  A manifest is written under another name and
moved into place; the move fails where that version exists, so that of two writers
one commits and the other starts over from the newer version.  Every few versions
a snapshot of all live shards is put beside the log, so that a commit or a reader
handles the latest snapshot and a few small manifests, however many shards exist.

No committed row is lost: manifests are never deleted, so that a version's number
can't be given twice; a writer makes sure that its own files still exist each time
it tries to commit; a merge commits only if all shards that it replaces are live.
``vacuum`` deletes only files that no live version names and that are older than a
stated age.  That age must be longer than any writer or reader takes; readers of a
replaced version, and writers, lose nothing until then.

A merge is a task that reads its group of shards and writes one file: nothing is
shuffled, and no group is larger than the target.  Tiers are powers of ``fanout``
over the smallest size; a tier is merged once it has ``fanout`` shards, so that a
row is rewritten at most once a tier.

Defined results: rows keep all columns and values, nulls, repeated rows, empty and
very long texts included (a file holds at least one whole row, however long);
columns that only some arrivals have are null in the rows of the others, and one
name with two types is an error; an empty arrival commits a version without new
shards; ties in size go by path.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from graphloom.llm import scratch as S

MERGES_A_JOB = 64
#: A snapshot stands at every so many versions.
SNAPSHOT_EVERY = 16
#: Seconds for which replaced and unnamed files stay: longer than any job runs.
KEEP_SECONDS = 7 * 24 * 3600


class Conflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Shard:
    path: str  # relative to the store
    rows: int
    bytes: int


@dataclass(frozen=True)
class State:
    """What a version holds."""

    version: int
    schema: StructType
    shards: tuple[Shard, ...]


def joined(a: StructType, b: StructType) -> StructType:
    """Fields of both; one name with two types is an error."""
    kinds = {f.name: f.dataType for f in a.fields}
    for f in b.fields:
        if kinds.setdefault(f.name, f.dataType) != f.dataType:
            raise ValueError(f"column {f.name} is {kinds[f.name].simpleString()} in the store and {f.dataType.simpleString()} in the arrival")
    return StructType([StructField(name, kind, True) for name, kind in kinds.items()])


class ShardStore:
    def __init__(self, spark: SparkSession, base: str, target_bytes: int = 128 << 20, fanout: int = 4, smallest_bytes: int = 1 << 20):
        self.spark, self.base = spark, base.rstrip("/")
        self.target, self.fanout, self.smallest = target_bytes, fanout, smallest_bytes

    # The log

    def _manifest(self, version: int) -> str:
        return f"{self.base}/manifests/{version:012d}.json"

    def _numbers(self, folder: str) -> list[int]:
        return sorted(int(n[:-5]) for n, _ in S.children(self.spark, f"{self.base}/{folder}") if n.endswith(".json"))

    def _said(self, path: str) -> dict:
        return json.loads(S.read_text(self.spark, path))

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max(self._numbers("manifests"), default=0)

    def state(self, version: int | None = None) -> State:
        """A version (the newest unless given): the snapshot before it and the manifests since."""
        v = self.version() if version is None else version
        at = max((n for n in self._numbers("snapshots") if n <= v), default=0)
        schema, live = StructType(), {}
        if at:
            said = self._said(f"{self.base}/snapshots/{at:012d}.json")
            schema, live = StructType.fromJson(said["schema"]), {x["path"]: Shard(**x) for x in said["shards"]}
        for n in range(at + 1, v + 1):
            said = self._said(self._manifest(n))
            schema = StructType.fromJson(said["schema"])
            for path in said["gone"]:
                live.pop(path)
            live.update({x["path"]: Shard(**x) for x in said["added"]})
        return State(v, schema, tuple(sorted(live.values(), key=lambda s: s.path)))

    def shards(self, version: int | None = None) -> list[Shard]:
        return list(self.state(version).shards)

    def _put(self, path: str, body: dict) -> None:
        """Write a file beside and move it into place, or raise Conflict where that exists."""
        jvm, folder = self.spark._jvm, path.rpartition("/")[0]
        part, fs = f"{folder}/_{uuid.uuid4().hex}", S.filesystem(self.spark, path)
        stream = fs.create(jvm.org.apache.hadoop.fs.Path(part), False)
        try:
            stream.write(bytearray(json.dumps(body).encode("utf-8")))
        finally:
            stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path), options)
        except Exception as e:
            S.delete(self.spark, part)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{path} exists") from e
            raise

    def _commit(self, version: int, added: list[Shard], gone: set[str], schema: StructType) -> None:
        """Make this the given version, or raise Conflict."""
        self._put(self._manifest(version), {"version": version, "schema": schema.jsonValue(), "added": [asdict(s) for s in added], "gone": sorted(gone)})

    def _missing(self, shards: list[Shard]) -> set[str]:
        """Those of the shards whose files are gone; one listing a folder."""
        folders = {s.path.rpartition("/")[0] for s in shards}
        there = {f"{f}/{n}" for f in folders for n, _ in S.children(self.spark, f"{self.base}/{f}")}
        return {s.path for s in shards} - there

    def _update(self, added: list[Shard], gone: set[str], schema: StructType, tries: int = 20) -> int:
        for _ in range(tries):
            now = self.state()
            if gone - {s.path for s in now.shards}:
                raise Conflict("a merged shard is no longer live")
            if lost := self._missing(added):
                raise Conflict(f"files were vacuumed before they were committed: {sorted(lost)[:3]}")
            try:
                self._commit(now.version + 1, added, gone, joined(now.schema, schema))
            except Conflict:
                continue
            if (now.version + 1) % SNAPSHOT_EVERY == 0:
                self._snapshot(now.version + 1)
            return now.version + 1
        raise Conflict("too many writers")

    def _snapshot(self, version: int) -> None:
        """All live shards of a version in one file; any writer's is as good."""
        state = self.state(version)
        try:
            self._put(f"{self.base}/snapshots/{version:012d}.json", {"schema": state.schema.jsonValue(), "shards": [asdict(s) for s in state.shards]})
        except Conflict:
            pass

    # Files

    def _write(self, df: DataFrame, kind: str, rows_a_shard: int = 0) -> list[Shard]:
        """Write one file for each partition that has rows, or several of that many rows."""
        folder = f"{kind}-{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows_a_shard).parquet(f"{self.base}/{folder}")
        found = self.spark.read.schema(df.schema).parquet(f"{self.base}/{folder}")
        # Row counts come from the files' footers; one row a shard.
        file = found.metadataColumn("_metadata")  # the rows may have a column of that name
        counts = found.groupBy(file["file_name"].alias("name"), file["file_size"].alias("size")).count().collect()
        return [Shard(f"{folder}/{r['name']}", r["count"], r["size"]) for r in sorted(counts)]

    def append(self, df: DataFrame, rows_a_shard: int = 0) -> int:
        """Commit the rows as small shards, a partition each or smaller; the version."""
        return self._update(self._write(df, "run", rows_a_shard), set(), df.schema)

    def tier(self, size: int) -> int:
        """0 up to the smallest size, then one more for each factor of fanout."""
        t, limit = 0, self.smallest
        while size > limit:
            t, limit = t + 1, limit * self.fanout
        return t

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Groups to merge now: shards of one tier, none above the target in sum."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target // 2:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        groups: list[list[Shard]] = []
        for _, own in sorted(tiers.items()):
            if len(own) < self.fanout:
                continue
            group, size = [], 0
            for s in sorted(own, key=lambda s: (-s.bytes, s.path)):
                if group and size + s.bytes > self.target:
                    groups.append(group)
                    group, size = [], 0
                group.append(s)
                size += s.bytes
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> int:
        """Merge until no tier is full; the version.  Replaced files stay until they are vacuumed."""
        while True:
            now = self.state()
            groups = self.plan(list(now.shards))[:MERGES_A_JOB]
            if not groups:
                return now.version
            reads = [self.spark.read.schema(now.schema).parquet(*(f"{self.base}/{s.path}" for s in g)).coalesce(1) for g in groups]
            merged = self._write(reduce(DataFrame.union, reads), "merged")
            if sum(s.rows for s in merged) != sum(s.rows for g in groups for s in g):
                raise RuntimeError("a merge changed the number of rows")
            self._update(merged, {s.path for g in groups for s in g}, now.schema)

    def vacuum(self, older_than: float = KEEP_SECONDS) -> int:
        """Delete files that the newest version doesn't name and that are older than so many seconds; how many went.

        Versions that named them can't be read afterwards.
        """
        before = (time.time() - older_than) * 1000
        fs, path = S.filesystem(self.spark, self.base), self.spark._jvm.org.apache.hadoop.fs.Path
        # Files are listed before the log is read, so that what is committed in between isn't taken for dead.
        old = [f"{f}/{x.getPath().getName()}" for f, _ in S.children(self.spark, self.base) if f.startswith(("run-", "merged-")) for x in fs.listStatus(path(f"{self.base}/{f}")) if x.getModificationTime() <= before]
        live = {s.path for s in self.state().shards}
        dead = [p for p in old if p.endswith(".parquet") and p not in live]
        for p in dead:
            S.delete(self.spark, f"{self.base}/{p}")
        return len(dead)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with the shard's path in column ``_metadata.file_path``."""
        state = self.state(version)
        paths = [f"{self.base}/{s.path}" for s in state.shards]
        return self.spark.read.schema(state.schema).parquet(*paths) if paths else self.spark.createDataFrame([], state.schema)


def shard_documents(arrivals: list[DataFrame], base: str, **options: int) -> tuple[ShardStore, int]:
    """Append each arrival to the store at ``base`` and compact it after each; the store and its version."""
    store = ShardStore(arrivals[0].sparkSession, base, **options)
    for docs in arrivals:
        store.append(docs)
        store.compact()
    return store, store.version()
