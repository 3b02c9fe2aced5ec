"""Kept fragments and resources, with expiry.

A fragment is the set of quads of a graph pattern.  A kept one serves every
pattern that is the same up to the names of variables, and every pattern that it
generalises, until its time is over or the seeds it was collected from change.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from collections.abc import Callable
from email.utils import parsedate_to_datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.streaming.state import GroupStateTimeout

from graphloom.functions import terms as T
from graphloom.functions.terms import Term, Var
from graphloom.plans.agp import AGP, parse_agp
from graphloom.plans.algebra import Call, Const, Expr, Ref
from graphloom.sources import store
from graphloom.streaming.runs import Runs

QUAD = ST.StructType([ST.StructField("tp", ST.StringType()), ST.StructField("s", T.TERM), ST.StructField("p", ST.StringType()), ST.StructField("o", T.TERM)])
LEAST_TTL, MOST_TTL = 1, 10_000_000
LEAST_CACHE = 5


def ttl_of(headers: dict[str, str], now: float | None = None) -> int | None:
    """Seconds to keep a response: max-age, else the time until Expires."""
    h = {k.lower(): v for k, v in headers.items()}
    if m := re.search(r"max-age\s*=\s*([0-9.]+)", h.get("cache-control", "")):
        return math.ceil(float(m[1]))
    if "expires" in h:
        try:
            end = parsedate_to_datetime(h["expires"]).timestamp()
        except (TypeError, ValueError):
            return None
        return max(0, math.ceil(end - (time.time() if now is None else now)))
    return None


def fresh(df: DataFrame, now: Column | float, column: str = "expires_at") -> DataFrame:
    """Rows whose time is not over."""
    return df.filter(F.col(column) > (now if isinstance(now, Column) else F.lit(now)))


def say(e: Expr, names: dict[str, str] | None = None) -> str:
    """A filter as text, to compare filters."""
    if isinstance(e, Ref):
        return f"?{(names or {}).get(e.var, e.var)}"
    if isinstance(e, Const):
        return str(e.term)
    if isinstance(e, Call):
        return f"{e.name}({', '.join(say(a, names) for a in e.args)})"
    return repr(e)


class FragmentCache:
    """Fragments as Parquet folders, each with an entry of its own in a catalog folder, so that writers never meet.

    ``observers`` are told (pattern, quads) of each fragment that is kept.
    """

    def __init__(self, spark: SparkSession, base: str | None = None, ttl: float = 3600, clock: Callable[[], float] = time.time):
        self.spark, self.ttl, self.clock = spark, ttl, clock
        self.base = base or f"{store.shared_dir(spark)}/fragments-{uuid.uuid4().hex}"
        self.hits = 0
        self.observers: list[Callable[[AGP, DataFrame], None]] = []

    def catalog(self) -> list[dict]:
        """Entries by name; the name goes along as ``id``."""
        folder = f"{self.base}/catalog"
        names = [n for n, _ in store.children(self.spark, folder) if n.endswith(".json")]
        found = self.spark.read.text([f"{folder}/{n}" for n in names], wholetext=True).collect() if names else []
        return sorted((json.loads(r[0]) for r in found), key=lambda r: (r["made_at"], r["id"]))

    def watch(self, observer: Callable[[AGP, DataFrame], None]) -> None:
        """Replay the fragments that are kept, then tell of each new one."""
        now = self.clock()
        for r in self.catalog():
            if r["expires_at"] > now:
                observer(parse_agp(r["pattern"]), self.spark.read.schema(QUAD).parquet(r["path"]))
        self.observers.append(observer)

    def get(self, agp: AGP, filters: list[Expr], make: Callable[[], DataFrame], digest: str = "", ttl: float | None = None) -> DataFrame:
        """Quads of the pattern, from a kept fragment if one serves, else collected and kept."""
        found = self.find(agp, filters, digest)
        if found is not None:
            self.hits += 1
            return found
        return self.put(agp, filters, make(), digest, ttl)

    def find(self, agp: AGP, filters: list[Expr], digest: str = "") -> DataFrame | None:
        """A kept fragment with the same filters, or with none; the same pattern before a more general one."""
        now = self.clock()
        rows = [r for r in self.catalog() if r["expires_at"] > now and r["digest"] == digest]
        rows.sort(key=lambda r: abs(len(r["filters"]) - len(filters)))
        general, constants = agp.general()
        for want, given in ((agp, {}), (general, constants)):
            for r in rows:
                kept = parse_agp(r["pattern"])
                mapping = kept.mapping(want)
                if mapping is None:
                    continue
                names = {a.name: b.name for a, b in mapping.items()}
                said = sorted(r["filters"])
                if said and sorted(_rename(f, names) for f in said) != sorted(say(f) for f in filters):
                    continue
                return self._mapped(r, kept, want, agp, mapping, given, filters if not said else [])
        return None

    def _mapped(self, r: dict, kept: AGP, want: AGP, agp: AGP, mapping: dict[Term, Term], given: dict[Var, Term], filters: list[Expr]) -> DataFrame:
        """The kept quads under the asked pattern's names, reduced to its constants and filters."""
        df = self.spark.read.schema(QUAD).parquet(r["path"])
        renamed = {t: type(t)(*(mapping.get(x, x) for x in t)) for t in kept.patterns}
        names = {name: want.names()[renamed[t]] for t, name in kept.names().items()}
        table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
        df = df.withColumn("tp", table[F.col("tp")])
        if not given and not filters:
            return df
        from graphloom.operators.reduction import reduce_quads

        return reduce_quads(self.spark, df, agp, want, filters)

    def put(self, agp: AGP, filters: list[Expr], quads: DataFrame, digest: str = "", ttl: float | None = None) -> DataFrame:
        """Write beside, then list; a failed write leaves nothing in the catalog."""
        began = self.clock()
        path = f"{self.base}/{uuid.uuid4().hex}"
        quads.select("tp", "s", "p", "o").write.parquet(path)
        took = self.clock() - began
        keep = min(max(self.ttl if ttl is None else ttl, took, LEAST_TTL), MOST_TTL)
        key = path.rpartition("/")[2]
        entry = {"id": key, "pattern": str(agp), "filters": [say(f) for f in filters], "path": path, "made_at": self.clock(), "expires_at": self.clock() + keep, "digest": digest}
        store.write_text(self.spark, f"{self.base}/catalog/{key}.json", json.dumps(entry))
        out = self.spark.read.schema(QUAD).parquet(path)
        for tell in self.observers:
            tell(agp, out)
        return out

    def purge(self, grace: float = 0, digest: str | None = None) -> int:
        """Delete fragments whose time has been over for ``grace`` seconds, and with a digest those of other seeds; how many went."""
        now = self.clock()
        gone = [r for r in self.catalog() if r["expires_at"] + grace <= now or digest is not None and r["digest"] != digest]
        for r in gone:
            store.delete(self.spark, f"{self.base}/catalog/{r['id']}.json")
            store.delete(self.spark, r["path"])
        return len(gone)


def _rename(said: str, names: dict[str, str]) -> str:
    return re.sub(r"\?(\w+)", lambda m: "?" + names.get(m[1], m[1]), said)


class FragmentStream:
    """Quads in order of arrival, each once; ``ts`` is the second of arrival.

    ``put`` tells new quads from kept ones by lookups in runs of their hashes, so a batch reads what it
    asks for and not the whole history.  ``append`` takes arrivals as they are.  Both are read by ``get`` (each quad
    with its first arrival) and by ``tail``.
    """

    SCHEMA = ST.StructType([*QUAD.fields, ST.StructField("ts", ST.LongType())])

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._index = Runs(spark, f"{self.base}-index", "tp string, s_ string, p string, o_ string")

    def put(self, quads: DataFrame, ts: int) -> int:
        """Append quads not yet there; how many were new.

        Quads are written before their index: after a failure between the two they may stand
        twice in the files, which no reader shows.
        """
        new = quads.select("tp", "s", "p", "o").distinct().withColumns({"s_": F.to_json("s"), "o_": F.to_json("o")})
        new = new.withColumn("k", F.xxhash64("tp", "s_", "p", "o_")).persist()
        runs, number = self._index.current(), self._index.last() + 1
        same = ["k", "tp", "s_", "p", "o_"]
        known = self._index.read(runs, new).select(*same)
        on = [new[c].eqNullSafe(known[c]) for c in same[1:]]
        fresh = new.join(known, [new["k"] == known["k"], *on], "left_anti").persist()
        n = fresh.count()
        if n:
            fresh.select("tp", "s", "p", "o", F.lit(ts).cast("long").alias("ts")).write.mode("append").parquet(self.base)
            self._index.commit(number, [*runs, self._index.write(fresh.select(*same), n)])
        new.unpersist(), fresh.unpersist()
        return n

    def append(self, quads: DataFrame) -> None:
        """Arrivals (tp, s, p, o, ts), repeats and all."""
        quads.select("tp", "s", "p", "o", F.col("ts").cast("long").alias("ts")).write.mode("append").parquet(self.base)

    def get(self, until: int | None = None) -> DataFrame:
        df = self.spark.read.schema(self.SCHEMA).parquet(self.base)
        df = df.groupBy("tp", "s", "p", "o").agg(F.min("ts").alias("ts"))
        return df if until is None else df.filter(F.col("ts") <= until).orderBy("ts")

    def tail(self, after: int | None = None, ttl: int | None = None, late: int | None = None, files: int | None = None) -> DataFrame:
        """A stream of quads as they arrive, those to come included.

        With ``after``, what ``get(after)`` replays is not told again, nor are repeats of it that arrive
        meanwhile.  A quad is told once, or with ``ttl`` (seconds) once more when it arrives over ``ttl`` after it
        was last told; its state is dropped once all that may still come is later than that.  ``late``
        (``ttl`` unless stated) is how far behind the newest arrival a quad may come; later ones are left out.
        Quads are told apart by keyed state that survives restarts with the query's checkpoint.  Arrivals are
        taken in the order of their files; ``files`` limits a trigger, so files of one append may come in any order.
        """
        stream = self.spark.readStream.schema(self.SCHEMA)
        stream = (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(self.base)
        rows = stream.select(F.to_json(F.struct("tp", "s", "p", "o")).alias("quad"), "ts", F.timestamp_seconds("ts").alias("at"))
        if ttl is not None:
            rows = rows.withWatermark("at", f"{ttl if late is None else late} seconds")
        told = rows.groupBy("quad").applyInPandasWithState(
            _teller(after, ttl), "quad string, ts long", "told long", "append", GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.EventTimeTimeout
        )
        return told.select(F.from_json("quad", QUAD).alias("q"), "ts").select("q.*", "ts")


def _teller(after: int | None, ttl: int | None):
    """Which arrivals of one quad are told, given when it was told last."""

    def run(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last, out = (state.get[0] if state.exists else None), []
        for t in sorted(int(t) for frame in frames for t in frame["ts"]):
            if last is None or ttl is not None and t - last > ttl:
                last = t
                out.append(t)
        state.update((last,))
        if ttl is not None:
            state.setTimeoutTimestamp(max((last + ttl) * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"quad": key[0], "ts": [t for t in out if after is None or t > after]}, columns=["quad", "ts"]).astype({"quad": "object", "ts": "int64"})

    return run


class ResourceCache:
    """Documents by resource, each until its time is over: (gid, data, expires_at).

    Rows are appended with the time they were written, in one of BUCKETS folders by a
    hash of the resource, so that one resource's lookup reads one folder; the newest
    row of a resource counts, and one without data is its end.  A purge writes the
    next generation of the whole table beside the old one, which readers use until it
    is complete.  Documents read lately are also kept in memory, MEMO of them.
    """

    SCHEMA = "gid string, data string, expires_at double, at double, b int"
    BUCKETS, MEMO = 64, 5000

    def __init__(self, spark: SparkSession, base: str, least: float = LEAST_CACHE, force: float | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.base, self.least, self.force, self.clock = spark, base.rstrip("/"), least, force, clock
        self.memo: dict[str, tuple[str, float]] = {}

    def _generations(self) -> list[int]:
        names = [n for n, _ in store.children(self.spark, self.base) if n.startswith("gen-")]
        return sorted(int(n[4:]) for n in names if store.exists(self.spark, f"{self.base}/{n}/_SUCCESS"))

    def _bucket(self, gid: Column) -> Column:
        return F.pmod(F.xxhash64(gid), F.lit(self.BUCKETS)).cast("int")

    def table(self, gid: str | None = None) -> DataFrame:
        """The newest version of each resource, or of one, whose time is not over."""
        have = self._generations()
        if not have:
            return self.spark.createDataFrame([], self.SCHEMA).select("gid", "data", "expires_at")
        df = self.spark.read.schema(self.SCHEMA).parquet(f"{self.base}/gen-{have[-1]}")
        if gid is not None:
            bucket = self.spark.range(1).select(self._bucket(F.lit(gid))).first()[0]
            df = df.filter((F.col("b") == bucket) & (F.col("gid") == gid))
        newest = df.groupBy("gid").agg(F.max_by(F.struct("data", "expires_at"), "at").alias("x")).select("gid", "x.data", "x.expires_at")
        return fresh(newest.filter("data is not null"), self.clock())

    def _write(self, gid: str, data: str | None, expires_at: float) -> None:
        row = self.spark.createDataFrame([(gid, data, expires_at, self.clock())], "gid string, data string, expires_at double, at double")
        generation = (self._generations() or [0])[-1]
        row.withColumn("b", self._bucket(F.col("gid"))).write.mode("append").partitionBy("b").parquet(f"{self.base}/gen-{generation}")

    def create(self, gid: str, loader: Callable[[str], tuple[str, dict[str, str]]]) -> str:
        """The kept document, or the loader's, which is kept for as long as its headers say."""
        if gid in self.memo and self.memo[gid][1] > self.clock():
            return self.memo[gid][0]
        found = self.table(gid).first()
        if found is None:
            data, headers = loader(gid)
            keep = self.force if self.force is not None else max(ttl_of(headers, self.clock()) or 0, self.least)
            found = (gid, data, self.clock() + keep)
            self._write(*found)
        self.memo[gid] = (found[1], found[2])
        while len(self.memo) > self.MEMO:
            self.memo.pop(next(iter(self.memo)))
        return found[1]

    def expire(self, gid: str) -> None:
        """End a resource's time."""
        self.memo.pop(gid, None)
        self._write(gid, None, 0.0)

    def purge(self) -> None:
        """Write the next generation without what is over, then delete the older ones."""
        have = self._generations()
        if have:
            rows = self.table().withColumn("at", F.lit(self.clock())).withColumn("b", self._bucket(F.col("gid")))
            rows.write.partitionBy("b").parquet(f"{self.base}/gen-{have[-1] + 1}")
            for n in have:
                store.delete(self.spark, f"{self.base}/gen-{n}")

    def published(self, base: str) -> DataFrame:
        """(s, p, o) text: what is kept, as resources of a base."""
        return self.table().select(F.lit(base).alias("s"), F.lit("urn:graphloom#hasResource").alias("p"), F.col("gid").alias("o"))

    def search(self, part: str) -> list[str]:
        return [r[0] for r in self.table().filter(F.contains("gid", F.lit(part))).select("gid").orderBy("gid").collect()]
