"""Property paths as tables of pairs; closures from the bound end.

A way is a table of (at, to) and how often.  Sequences of ways count their pairs instead of repeating them, so a step between
resources with many neighbours is as large as its different pairs; rows are repeated once, at the end.  A closure is semi-naive: each round joins only the pairs that are new with one step,
and is one job that cuts the lineage.  It begins at the ends that are bound, forwards or
backwards, so that what they don't reach is never looked at.  Where every resource has one way on at most, pairs are
doubled after some rounds: a chain takes as many rounds as its length has binary digits.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import functions as F

from graphloom.functions import values as V
from graphloom.functions.terms import Var
from graphloom.functions.values import Kind
from graphloom.operators import solutions as S
from graphloom.operators.solutions import Solutions
from graphloom.plans.algebra import Triple
from graphloom.sources.store import checkpoint

AT, TO = "at", "to"
#: How often a pair stands; no variable can have this name.
N = "*n"
PATIENCE = 8
_A, _T, _N = S.column(AT), S.column(TO), S.column(N)


def renamed(x: Solutions, names: dict[str, str]) -> Solutions:
    """These variables alone, under other names."""
    return Solutions(x.df.select(*(x.col(v).alias(S.column(n)) for v, n in names.items())), {n: x.kinds[v] for v, n in names.items()})


def swapped(x: Solutions) -> Solutions:
    return renamed(x, {TO: AT, AT: TO, N: N})


def _once(x: Solutions) -> Solutions:
    return Solutions(x.df.withColumn(_N, F.lit(1).cast("bigint")), x.kinds | {N: Kind("int")})


def _grouped(way: tuple, x: Solutions) -> Solutions:
    """Each pair once, with its count; one property's pairs and sets are not looked at again."""
    return Solutions(x.df.groupBy(_A, _T).agg(F.sum(f"`{_N}`").alias(_N)), x.kinds) if repeats(way) or way[0] == "|" else x


def repeats(way: tuple) -> bool:
    """Whether a way's pairs can count more than once."""
    return way[0] == "/" or way[0] in "^|" and any(map(repeats, way[1:]))


class Paths:
    def __init__(self, spark, data):
        self.spark, self.data = spark, data

    def pairs(self, way: tuple, starts: Solutions | None = None) -> Solutions:
        """(at, to, how often) of a way, from ``starts`` (at) if they are given; closures are sets, pairs of other ways may stand in several rows."""
        kind = way[0]
        if kind == "p":
            out = self.data.bgp((Triple(Var(AT), way[1], Var(TO)),), self.spark)
            if set(out.kinds) != {AT, TO}:
                raise NotImplementedError("a closure within a graph that is not named")
            return _once(out if starts is None else S.semi(out, starts))
        if kind == "^":
            out = swapped(self.pairs(way[1]))
            return out if starts is None else S.semi(out, starts)
        if kind == "|":
            return reduce(S.union, [self.pairs(w, starts) for w in way[1:]])
        if kind == "/":
            out, done = self.pairs(way[1], starts), way[1]
            for w in way[2:]:
                out = _grouped(done, out)
                on = renamed(Solutions(out.df.select(out.col(TO)).distinct(), {TO: out.kinds[TO]}), {TO: AT})
                both = S.join(renamed(out, {AT: AT, TO: "between", N: "*before"}), renamed(_grouped(w, self.pairs(w, on)), {AT: "between", TO: TO, N: N}))
                times = both.df.withColumn(_N, both.col("*before") * both.col(N))
                out, done = renamed(Solutions(times, both.kinds), {AT: AT, TO: TO, N: N}), way
            return _grouped(way, out)
        if starts is None and kind != "+":
            raise NotImplementedError("a path of length zero needs a bound end")
        none = None if starts is None else Solutions(starts.df.select(starts.col(AT).alias(_A), starts.col(AT).alias(_T)), {AT: starts.kinds[AT], TO: starts.kinds[AT]})
        if kind == "?":
            return _once(S.union(none, renamed(self.pairs(way[1], starts), {AT: AT, TO: TO})).distinct())
        out = self.closure(way[1], starts)
        return _once(out if kind == "+" else S.union(none, out).distinct())

    def closure(self, way: tuple, starts: Solutions | None) -> Solutions:
        """One step or more, from the starts or from everywhere."""
        step = renamed(self.pairs(way if way[0] in ("p", "^", "|", "/", "+") else ("+", way[1])), {AT: AT, TO: TO})
        kind = V.meet(step.kinds[AT], step.kinds[TO]).sure()
        step = step.to({AT: kind, TO: kind})
        step = Solutions(checkpoint(step.df.distinct()), step.kinds)
        own = step if starts is None else S.semi(step, starts).to({AT: kind, TO: kind})
        found = frontier = checkpoint(own.df)
        for done in count(1):
            if done == PATIENCE and step.df.groupBy(_A).count().filter("count > 1").isEmpty():
                return Solutions(self._doubled(checkpoint(own.df), step.df), step.kinds)
            on = step.df.select(F.col(_A).alias("between"), F.col(_T).alias("next"))
            ahead = frontier.join(on, F.col(_T) == F.col("between")).select(_A, F.col("next").alias(_T)).distinct()
            frontier = checkpoint(ahead.join(found, [_A, _T], "left_anti"))
            if frontier.isEmpty():
                return Solutions(found, step.kinds)
            both = found.unionByName(frontier)
            found = checkpoint(both) if done % PATIENCE == 0 else both

    def _doubled(self, found, jump):
        """``found`` holds the pairs up to 2^k steps apart, ``jump`` those exactly 2^k apart."""
        while True:
            on = jump.select(F.col(_A).alias("between"), F.col(_T).alias("next"))
            onward = lambda df, on=on: df.join(on, F.col(_T) == F.col("between")).select(_A, F.col("next").alias(_T))
            new = checkpoint(onward(found).distinct().join(found, [_A, _T], "left_anti"))
            if new.isEmpty():
                return found
            found, jump = checkpoint(found.unionByName(new)), checkpoint(onward(jump))
