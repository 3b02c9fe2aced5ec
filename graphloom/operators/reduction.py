"""Reducing a kept fragment to a pattern's constants and filters by semi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions import values as V
from graphloom.functions.terms import Var
from graphloom.operators import solutions as S
from graphloom.operators.solutions import Solutions
from graphloom.plans.agp import AGP
from graphloom.plans.algebra import Expr, free


def reduce_quads(spark: SparkSession, quads: DataFrame, agp: AGP, want: AGP, filters: list[Expr]) -> DataFrame:
    """Quads that take part in a match of ``agp``.

    ``want`` has the same patterns in the same order, perhaps with variables for
    constants.  The patterns' tables are joined on their variables and each is
    cut to what the join has; a fragment is small beside the data it came from.
    """
    from graphloom.plans.compiler import Compiler

    compiler = Compiler(spark, None)
    tables = []
    for i, t in enumerate(agp.patterns):
        own = quads.filter(F.col("tp") == want.names()[want.patterns[i]])
        bound = {}
        for x, name in ((t.s, "s"), (t.o, "o")):
            col = F.col(name)
            if isinstance(x, Var):
                if x.name in bound:
                    own = own.filter(bound[x.name] == col)
                bound.setdefault(x.name, col)
            else:
                own = own.filter(col == T.lit(x))
        s = Solutions(own.select(*(c.alias(S.column(v)) for v, c in bound.items())), {v: V.TERM_KIND for v in bound})
        for f in filters:
            if free(f) <= set(s.kinds):
                s = Solutions(s.df.filter(compiler.expressions(s.values()).test(f)), s.kinds)
        tables.append((t, s))
    whole = S.join_all([s for _, s in tables], spark)
    out = []
    for t, s in tables:
        kept = S.semi(s, Solutions(whole.df.select(*(whole.col(v).alias(S.column(v)) for v in s.kinds)), s.kinds)) if s.kinds else S.semi(s, whole)
        side = lambda x, kept=kept: kept.col(x.name) if isinstance(x, Var) else T.lit(x)
        out.append(kept.df.select(F.lit(agp.names()[t]).alias("tp"), side(t.s).alias("s"), F.lit(t.p.value).alias("p"), side(t.o).alias("o")))
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result.distinct()
