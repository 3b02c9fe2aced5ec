"""Collecting linked data along a plan, a level of resources at a time.

Each level is loaded in parallel, its triples go into a table in the shared
folder, and the next level is what the plan's property leads to from it, round
after round of a cycle until nothing new is reached; more than ``most_rounds``,
where it is set, are an error, never a part of the result.  The
result is a triple store over what was found, over which any query runs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.terms import Iri, Literal
from graphloom.operators.vocabulary import Vocabulary
from graphloom.plans.planner import Plan, Tree
from graphloom.sources import store
from graphloom.sources.dereference import TTL_SCHEMA, Loader, dereference
from graphloom.sources.triples import TripleStore


@dataclass
class Crawl:
    spark: SparkSession
    vocab: Vocabulary
    loader: Loader | None = None
    most_rounds: int | None = None
    base: str = ""
    n_derefs: int = 0
    levels: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.base = self.base or f"{store.shared_dir(self.spark)}/crawl-{uuid.uuid4().hex}"
        self._n = 0

    @property
    def seen(self) -> DataFrame:
        """The resources that were loaded."""
        return self.spark.read.schema("uri string").parquet(f"{self.base}/seen") if self._n else self.spark.createDataFrame([], "uri string")

    def _triples(self) -> DataFrame:
        return self._rows().select("g", "s", "p", "o")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(TTL_SCHEMA).parquet(*(f"{self.base}/{i}" for i in range(self._n))) if self._n else self.spark.createDataFrame([], TTL_SCHEMA)

    def ttl(self) -> int:
        """Seconds for which what was found may be kept: the least of its resources; 0 where none says."""
        return self._rows().agg(F.coalesce(F.min("ttl"), F.lit(0))).first()[0]

    def _load(self, uris: DataFrame) -> None:
        """Load the resources that were not loaded yet."""
        new = store.checkpoint(uris.distinct().join(self.seen, "uri", "left_anti"))
        n = new.count()
        self.levels.append(n)
        if not n:
            return
        self.n_derefs += n
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dereference(new.repartition(min(parts, n)), self.loader, with_ttl=True).write.parquet(f"{self.base}/{self._n}")
        new.write.mode("append").parquet(f"{self.base}/seen")
        self._n += 1

    def _follow(self, uris: DataFrame, prop: str) -> DataFrame:
        """Objects of the property, and subjects of its inverses."""
        t = self._triples()
        back = sorted(self.vocab.facts.inverses(prop))
        pairs = t.filter(F.col("p") == prop).select("s", "o")
        if back:
            pairs = pairs.unionByName(t.filter(F.col("p").isin(*back)).select(F.col("o").alias("s"), F.col("s").alias("o")))
        return pairs.join(uris, F.col("s.lex") == F.col("uri"), "left_semi").filter(F.col("o.kind") == T.IRI).select(F.col("o.lex").alias("uri")).distinct()

    def collect(self, plan: Plan) -> TripleStore:
        """Everything that the plan's trees lead to."""
        for space in plan.spaces:
            for tree in space.trees:
                at = self._reach(tree)
                wire = space.agp.wire()
                todo = [(tree.root, at)]
                visited = {tree.root}
                while todo:
                    node, uris = todo.pop()
                    self._load(uris)
                    for t, o in wire.get(node, []):
                        if isinstance(t.p, Iri) and o not in visited and not isinstance(o, Literal) and wire.get(o):
                            visited.add(o)
                            todo.append((o, store.checkpoint(self._follow(uris, t.p.value))))
        return TripleStore(self._triples(), ttl=self.ttl() or None)

    def _reach(self, tree: Tree) -> DataFrame:
        at = self.spark.createDataFrame([(s,) for s in tree.seeds], "uri string")
        for _, prop in tree.steps:
            self._load(at)
            at = store.checkpoint(self._follow(at, prop))
        if not tree.cycles:
            return at
        # All cycles together: what one of them reaches, another may lead on from.
        reached = frontier = store.checkpoint(at)
        for done in count():
            if done == self.most_rounds:
                raise RuntimeError(f"no end of the cycles after {done} rounds")
            ends = []
            for cycle in tree.cycles:
                step = frontier
                for _, prop in cycle:
                    self._load(step)
                    step = store.checkpoint(self._follow(step, prop))
                ends.append(step)
            frontier = store.checkpoint(reduce(DataFrame.unionByName, ends).distinct().join(reached, "uri", "left_anti"))
            if frontier.isEmpty():
                return reached
            both = reached.unionByName(frontier)
            reached = store.checkpoint(both) if done % 8 == 7 else both
