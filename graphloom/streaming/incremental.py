"""Answers of a graph pattern while its triples arrive.

Each batch is joined with what came before by the delta rule: for every pattern
the batch's own triples, with the patterns before it over old and new triples and
the patterns after it over old ones.  An answer is therefore made once, by the
batch that completes it, and cyclic patterns need no special case.

What came before is kept per pattern under each variable by which it is joined (``Runs``), and
reached by lookups: a batch starts from its own triples, and each further pattern is read only where the
keys found so far are.  Its reading is in proportion to the batch and its answers, not to what is kept.
Answers are Parquet, a folder a batch; a batch that is run again after a failure replaces its own folder, and one that was
taken in already is left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions import terms as T
from graphloom.functions import values as V
from graphloom.functions.expressions import Expressions
from graphloom.functions.terms import Var
from graphloom.operators import solutions as S
from graphloom.plans.agp import AGP
from graphloom.plans.algebra import Triple
from graphloom.plans.compiler import shown
from graphloom.sources import store
from graphloom.sources.triples import TripleStore
from graphloom.streaming.runs import Run, Runs

_ROW = f"slot int, side string, s {T.TERM.simpleString()}, p string, o {T.TERM.simpleString()}"


def _names(t: Triple) -> list[str]:
    return [x.name for x in dict.fromkeys(t) if isinstance(x, Var)]


def _key(side: str, value: Column) -> Column:
    return F.xxhash64(F.lit(side), value["kind"], value["lex"], value["dt"], value["lang"])


class IncrementalPattern:
    """Feed batches of quads (tp, s, p, o) or triples (s, p, o); read answers at any time."""

    def __init__(self, spark: SparkSession, agp: AGP, base: str, filters: list | None = None, bucket_rows: int = 200_000):
        self.spark, self.agp, self.base, self.filters = spark, agp, base.rstrip("/"), filters or []
        self.vars = sorted({x for t in agp.patterns for x in _names(t) if not x.startswith("_")})
        self.patterns = list(agp.patterns)
        self.runs = Runs(spark, f"{self.base}/state", _ROW, bucket_rows)
        #: Bytes of kept triples that each batch looked at, by its number.
        self.looked: dict[int, int] = {}
        # A pattern that shares no variable is kept under whole triples.
        self.sides = [[v for v in _names(t) if any(v in _names(u) for u in self.patterns if u is not t)] or ["*"] for t in self.patterns]

    def _value(self, t: Triple, side: str) -> Column:
        """The term that stands where a pattern has a variable."""
        if side == "*":
            return T.make(T.LITERAL, F.concat_ws("\n", "s.lex", "p", "o.lex"))
        for x, c in ((t.s, F.col("s")), (t.o, F.col("o")), (t.p, T.make(T.IRI, F.col("p")))):
            if isinstance(x, Var) and x.name == side:
                return c
        raise KeyError(side)

    def _matching(self, new: DataFrame) -> DataFrame:
        """The batch's triples by pattern and side."""
        parts = []
        for i, t in enumerate(self.patterns):
            sides = F.array(*(F.struct(F.lit(v).alias("side"), _key(v, self._value(t, v)).alias("k")) for v in self.sides[i]))
            parts.append(TripleStore(new, disjoint=True).matching(t).select(F.lit(i).alias("slot"), F.explode(sides).alias("e"), "s", "p", "o").select("e.k", "slot", "e.side", "s", "p", "o"))
        return reduce(DataFrame.unionByName, parts)

    def _scan(self, rows: DataFrame, i: int, side: str) -> S.Solutions:
        own = rows.filter((F.col("slot") == i) & (F.col("side") == side))
        return TripleStore(own.withColumn("g", F.lit(None).cast("string")), disjoint=True).bgp((self.patterns[i],), self.spark)

    def feed(self, batch: DataFrame, number: int) -> None:
        """Take in one batch; feeding a number again has no further effect."""
        if number <= self.runs.last():
            return
        self.runs.bytes_read = 0
        old = self.runs.current()
        came = self._matching(batch.select(F.lit(None).cast("string").alias("g"), "s", "p", "o").distinct()).persist()
        first = reduce(lambda a, b: a | b, ((F.col("slot") == i) & (F.col("side") == s[0]) for i, s in enumerate(self.sides)))
        known = self.runs.read(old, came.filter(first)).filter(first).select("slot", "s", "p", "o")
        on = reduce(lambda a, b: a & b, (came[c].eqNullSafe(known[c]) for c in ("slot", "s", "p", "o")))
        fresh = came.join(known, on, "left_anti").persist()
        counts = {r[0]: r[1] for r in fresh.groupBy("slot").count().collect()}
        runs, answers = old, []
        if counts:
            run = self.runs.write(fresh, sum(counts.values()))
            runs = [*old, run]
            answers = [self._completed(i, run, old) for i in counts]
        held = [df for _, more in answers for df in more]
        found = reduce(S.union, (a for a, _ in answers)) if answers else S.nothing(self.vars, self.spark)
        for f in self.filters:
            found = S.Solutions(found.df.filter(Expressions(found.values()).test(f)), found.kinds)
        rows = found.df.select(*(shown(found.col(v), found.kinds[v]).alias(v) for v in self.vars))
        rows.write.mode("overwrite").parquet(f"{self.base}/answers/{number:09d}")
        self.looked[number] = self.runs.bytes_read
        self.runs.commit(number, runs)
        for df in (came, fresh, *held):
            df.unpersist()

    def _completed(self, i: int, run: Run, old: list[Run]) -> tuple[S.Solutions, list[DataFrame]]:
        """Answers that pattern i's new triples complete, and the tables held on the way."""
        new = self.spark.read.schema(self.runs.columns).parquet(*(f"{run.path}/b={b}" for b in run.sizes))
        out, held = self._scan(new, i, self.sides[i][0]), []
        todo = [j for j in range(len(self.patterns)) if j != i]
        while todo:
            j = next((j for j in todo if set(self.sides[j]) & set(out.kinds)), todo[0])
            todo.remove(j)
            side = next((v for v in self.sides[j] if v in out.kinds), self.sides[j][0])
            keys = None
            if side in out.kinds:
                held.append(out.df.persist())
                keys = out.df.select(_key(side, V.as_term(out.col(side), out.kinds[side])).alias("k"))
            rows = self.runs.read(old, keys)
            out = S.join(out, self._scan(rows.unionByName(new) if j < i else rows, j, side))
        return out, held

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a stream of quads, such as ``FragmentStream.tail``."""
        return stream.writeStream.foreachBatch(self.feed).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def answers(self) -> DataFrame:
        """All answers so far, without repeats."""
        last = self.runs.last()
        names = [n for n, _ in store.children(self.spark, f"{self.base}/answers") if n.isdigit() and int(n) <= last]
        schema = ", ".join(f"`{v}` string" for v in self.vars)
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*(f"{self.base}/answers/{n}" for n in names)).distinct()
