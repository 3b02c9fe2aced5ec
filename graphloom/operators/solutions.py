"""Solution tables and the operators between them.

A solution table is a DataFrame with one column for each variable and the kind
of each.  A variable is certain if it is bound in every row; joins on certain
variables are plain equi-joins, others follow SPARQL's compatibility: unbound
agrees with everything.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import values as V
from graphloom.functions.values import Kind


def column(var: str) -> str:
    """A column name for a variable; Spark does not tell capitals apart, SPARQL does."""
    return "v_" + "".join(f"^{c.lower()}" if c.isupper() else c for c in var)


@dataclass
class Solutions:
    df: DataFrame
    kinds: dict[str, Kind]

    def col(self, var: str) -> Column:
        return F.col(f"`{column(var)}`")

    def values(self) -> dict[str, tuple[Column, Kind]]:
        return {v: (self.col(v), k) for v, k in self.kinds.items()}

    def to(self, kinds: dict[str, Kind]) -> Solutions:
        """The variables of ``kinds``, converted; those missing are unbound."""
        cols = []
        for v, k in kinds.items():
            c = V.convert(self.col(v), self.kinds[v], k) if v in self.kinds else F.lit(None).cast(k.sql())
            cols.append(c.alias(column(v)))
        return Solutions(self.df.select(*cols), dict(kinds))

    def distinct(self) -> Solutions:
        return Solutions(self.df.distinct() if self.kinds else self.df.limit(1), self.kinds)


def unit(spark) -> Solutions:
    """One solution that binds nothing."""
    return Solutions(spark.range(1).select(), {})


def nothing(names: list[str], spark) -> Solutions:
    """No solution, over these variables."""
    df = spark.range(1).filter(F.lit(False)).select(*(F.lit(None).cast("string").alias(column(n)) for n in names))
    return Solutions(df, {n: Kind("iri") for n in names})


def _meet(a: Solutions, b: Solutions) -> tuple[Solutions, Solutions, list[str]]:
    """Both sides with one kind for each shared variable, certainty kept by side."""
    shared = [v for v in a.kinds if v in b.kinds]
    both = {v: V.meet(a.kinds[v], b.kinds[v]) for v in shared}

    def side(x: Solutions) -> Solutions:
        if all(x.kinds[v].like(both[v]) for v in shared):
            return x
        kinds = {v: (Kind(both[v].name, both[v].prefix, k.certain, both[v].key) if v in both else k) for v, k in x.kinds.items()}
        return x.to(kinds)

    return side(a), side(b), shared


def _right(b: Solutions, shared: list[str]) -> DataFrame:
    """The right side with its shared columns renamed."""
    return b.df.withColumnsRenamed({column(v): f"r_{column(v)}" for v in shared})


def compatible(a: Solutions, b: Solutions, shared: list[str]) -> Column:
    out = F.lit(True)
    for v in shared:
        x, y = F.col(f"`{column(v)}`"), F.col(f"`r_{column(v)}`")
        test = x == y
        if not a.kinds[v].certain:
            test = test | x.isNull()
        if not b.kinds[v].certain:
            test = test | y.isNull()
        out = out & test
    return out


def merged(a: Solutions, b: Solutions, shared: list[str]) -> dict[str, tuple[Column, Kind]]:
    """All variables of a joined row, before its right columns go."""
    out = {}
    for v in [*a.kinds, *(v for v in b.kinds if v not in a.kinds)]:
        c = F.col(f"`{column(v)}`")
        k = a.kinds.get(v) or b.kinds[v]
        if v in shared and not a.kinds[v].certain:
            c, k = F.coalesce(c, F.col(f"`r_{column(v)}`")), (k.sure() if b.kinds[v].certain else k)
        out[v] = (c, k)
    return out


def _out(df: DataFrame, values: dict[str, tuple[Column, Kind]]) -> Solutions:
    return Solutions(df.select(*(c.alias(column(v)) for v, (c, _) in values.items())), {v: k for v, (_, k) in values.items()})


def join(a: Solutions, b: Solutions, reference: bool = False) -> Solutions:
    """Join; ``reference``: the right side counts as a set."""
    if reference:
        b = b.distinct()
    a, b, shared = _meet(a, b)
    unsure = [v for v in shared if not (a.kinds[v].certain and b.kinds[v].certain)]
    if unsure and len(unsure) == len(shared):
        return _by_masks(a, b, shared)
    on = compatible(a, b, shared) if shared else None
    df = a.df.join(_right(b, shared), on, "inner") if shared else a.df.crossJoin(b.df)
    return _out(df, merged(a, b, shared))


def _bound(x: Solutions, v: str) -> Solutions:
    """The rows that bind a variable."""
    return x if x.kinds[v].certain else Solutions(x.df.filter(x.col(v).isNotNull()), {n: k.sure() if n == v else k for n, k in x.kinds.items()})


def _unbound(x: Solutions, v: str) -> Solutions | None:
    """The rows that don't, without it; None if there can be none."""
    return None if x.kinds[v].certain else _without(Solutions(x.df.filter(x.col(v).isNull()), x.kinds), v)


def _without(x: Solutions, v: str) -> Solutions:
    return Solutions(x.df.drop(column(v)), {n: k for n, k in x.kinds.items() if n != v})


def _unsure(a: Solutions, b: Solutions, shared: list[str]) -> str | None:
    """The variable to cut by where no shared one is certain on both sides: one that is on one side, if there is."""
    if not shared or any(a.kinds[v].certain and b.kinds[v].certain for v in shared):
        return None
    return max(shared, key=lambda v: (a.kinds[v].certain + b.kinds[v].certain, -shared.index(v)))


def _by_masks(a: Solutions, b: Solutions, shared: list[str]) -> Solutions:
    """No shared variable is certain on both sides: rows meet by which shared variables each binds.

    A row is repeated for each set of variables that the other side can bind, with the values that both
    then have as its key; one equi-join does the rest, and each side is read once.
    """

    def masks(x: Solutions) -> list[int]:
        out = [0]
        for i, v in enumerate(shared):
            out = [m | 1 << i for m in out] if x.kinds[v].certain else [y for m in out for y in (m, m | 1 << i)]
        return out

    def keyed(x: Solutions, own: str, other: str, others: list[int], name: Callable[[str], str]) -> DataFrame:
        bound = reduce(lambda p, q: p + q, (F.when(x.col(v).isNotNull(), F.lit(1 << i)).otherwise(0) for i, v in enumerate(shared)))
        df = x.df.withColumn(own, bound).withColumn(other, F.explode(F.array(*map(F.lit, others))))
        both = F.col(own).bitwiseAND(F.col(other))
        df = df.withColumns({f"{name('key')}{i}": F.when(both.bitwiseAND(F.lit(1 << i)) > 0, x.col(v)) for i, v in enumerate(shared)})
        return df.withColumnsRenamed({column(v): name(column(v)) for v in shared})

    left = keyed(a, "m_a", "m_b", masks(b), lambda c: c if c != "key" else "k_a")
    right = keyed(b, "n_b", "n_a", masks(a), lambda c: f"r_{c}" if c != "key" else "k_b")
    on = (F.col("m_a") == F.col("n_a")) & (F.col("m_b") == F.col("n_b"))
    for i in range(len(shared)):
        on = on & F.col(f"k_a{i}").eqNullSafe(F.col(f"k_b{i}"))
    df = left.join(right, on)
    values = {}
    for v in [*a.kinds, *(v for v in b.kinds if v not in a.kinds)]:
        c = F.col(f"`{column(v)}`")
        k = a.kinds.get(v) or b.kinds[v]
        if v in shared and not a.kinds[v].certain:
            c, k = F.coalesce(c, F.col(f"`r_{column(v)}`")), (k.sure() if b.kinds[v].certain else k)
        values[v] = (c, k)
    return _out(df, values)


def left_join(a: Solutions, b: Solutions, condition=None) -> Solutions:
    """OPTIONAL; ``condition`` makes a column of the merged row's values and stands in the ON clause."""
    a, b, shared = _meet(a, b)
    if _unsure(a, b, shared):

        def matched(x: Solutions) -> Solutions:
            both = join(x, b)
            return both if condition is None else Solutions(both.df.filter(F.coalesce(condition(both.values()), F.lit(False))), both.kinds)

        return optional(a, b, matched)
    values = merged(a, b, shared)
    on = compatible(a, b, shared)
    if condition is not None:
        on = on & F.coalesce(condition(values), F.lit(False))
    df = a.df.join(_right(b, shared), on, "left")
    return _out(df, {v: (c, k if v in a.kinds and a.kinds[v].certain else k.maybe()) for v, (c, k) in values.items()})


def optional(a: Solutions, b: Solutions, matched: Callable[[Solutions], Solutions]) -> Solutions:
    """What ``matched`` makes of a (a's rows joined with b's), and a's rows of which it made nothing.

    The variables that the join may bind keep a copy, so that a's rows are told by
    all that they bound before; rows that bind the same have the same matches.
    """
    copies = {f"*{v}": v for v, k in a.kinds.items() if not k.certain and v in b.kinds}
    own = Solutions(a.df.withColumns({column(c): a.col(v) for c, v in copies.items()}), a.kinds | {c: a.kinds[v] for c, v in copies.items()})
    both = matched(own)
    was = {v: k for k, v in copies.items()}
    made = both.df.select(*(both.col(was.get(v, v)).alias(f"r_{column(v)}") for v in a.kinds)).distinct()
    on = F.lit(True)
    for v in a.kinds:
        x, y = a.col(v), F.col(f"`r_{column(v)}`")
        on = on & (x == y if a.kinds[v].certain else x.eqNullSafe(y))
    rest = Solutions(a.df.join(made, on, "left_anti"), a.kinds)
    return union(Solutions(both.df.drop(*(column(c) for c in copies)), {v: k for v, k in both.kinds.items() if v not in copies}), rest)


def minus(a: Solutions, b: Solutions) -> Solutions:
    """Rows of a without a compatible row of b that shares a bound variable."""
    x, y, shared = _meet(a, b)
    if not shared:
        return a
    v = _unsure(x, y, shared)
    if v is None:
        on = compatible(x, y, shared)
        return Solutions(x.df.join(_right(y, shared).select(*(f"`r_{column(v)}`" for v in shared)), on, "left_anti"), x.kinds)
    bound, free = minus(_bound(x, v), _bound(y, v)), _unbound(y, v)
    if free is not None:
        bound = minus(bound, free)
    rest = _unbound(x, v)
    return bound if rest is None else union(bound, minus(rest, _without(y, v))).to(x.kinds)


def semi(a: Solutions, b: Solutions, anti: bool = False, condition=None) -> Solutions:
    """EXISTS or NOT EXISTS."""
    x, y, shared = _meet(a, b)
    if not shared and condition is None:
        some = y.df.select(F.lit(True).alias("_some")).limit(1)
        return Solutions(x.df.join(some, F.lit(True), "left_anti" if anti else "left_semi"), x.kinds)
    v = _unsure(x, y, shared)
    if v is not None:
        bound, free, rest = _bound(x, v), _unbound(y, v), _unbound(x, v)
        left = semi(bound, _bound(y, v), True, condition)
        if anti:
            out = left if free is None else semi(left, free, True, condition)
        else:
            out = semi(bound, _bound(y, v), False, condition)
            out = out if free is None else union(out, semi(left, free, False, condition))
        return out.to(x.kinds) if rest is None else union(out, semi(rest, y, anti, condition)).to(x.kinds)
    on = compatible(x, y, shared)
    if condition is not None:
        on = on & F.coalesce(condition(merged(x, y, shared)), F.lit(False))
    return Solutions(x.df.join(_right(y, shared), on, "left_anti" if anti else "left_semi"), x.kinds)


def union(a: Solutions, b: Solutions, reference: bool = False) -> Solutions:
    """All rows of both; ``reference``: of the right side those that the left side lacks."""
    kinds = {}
    for v in [*a.kinds, *(v for v in b.kinds if v not in a.kinds)]:
        k = V.meet(a.kinds[v], b.kinds[v]) if v in a.kinds and v in b.kinds else a.kinds.get(v) or b.kinds[v]
        sure = v in a.kinds and v in b.kinds and a.kinds[v].certain and b.kinds[v].certain
        kinds[v] = k.sure() if sure else k.maybe()
    x, y = a.to(kinds), b.to(kinds)
    right = y.df
    if reference and kinds:
        on = F.lit(True)
        for v in kinds:
            on = on & F.col(f"`{column(v)}`").eqNullSafe(F.col(f"`r_{column(v)}`"))
        right = right.join(_right(x, list(kinds)), on, "left_anti")
    return Solutions(x.df.unionByName(right), kinds)


#: Rows that one row's count is cut into.
MOST_REPEATS = 1 << 16


def repeated(x: Solutions, n: str) -> Solutions:
    """Each row as often as its count ``n`` says, which goes.

    Counts are cut and their parts dealt to all tasks before rows are repeated, a row at a time; so neither few rows of
    large counts nor one such row makes a task's whole work.
    """
    c, kinds = x.col(n), {v: k for v, k in x.kinds.items() if v != n}
    parts = x.df.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((c - 1) / MOST_REPEATS))))
    dealt = parts.repartition(int(x.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_part", *(x.col(v) for v in kinds))
    rows = dealt.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(MOST_REPEATS), c - F.col("_part") * MOST_REPEATS))))
    return Solutions(rows.select(*(x.col(v) for v in kinds)), kinds)


def join_all(parts: list[Solutions], spark) -> Solutions:
    """Join connected parts before others, so that no product is made where none is asked for."""
    if not parts:
        return unit(spark)
    todo = list(parts)
    out = todo.pop(0)
    while todo:
        i = next((i for i, p in enumerate(todo) if set(p.kinds) & set(out.kinds)), 0)
        out = join(out, todo.pop(i))
    return out
