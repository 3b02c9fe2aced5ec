"""From algebra to DataFrames.

Every node becomes DataFrame operations; Catalyst and adaptive execution choose
how to run them.  ``semantics="reference"`` keeps three set-like habits that
engines of this kind are known for: a join's right side counts as a set, a union
leaves out right rows that the left side has, and a group by over nothing gives one
empty row.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import expressions as E
from graphloom.functions import terms as T
from graphloom.functions import values as V
from graphloom.functions.terms import BNode, Term, Var
from graphloom.functions.values import Kind
from graphloom.operators import solutions as S
from graphloom.operators.closure import AT, TO, N, Paths, renamed, repeats, swapped
from graphloom.operators.solutions import Solutions, column
from graphloom.plans import algebra as A

Hook = Callable[["Compiler", A.Node], Solutions | None]


class Compiler:
    def __init__(self, spark: SparkSession, data, semantics: str = "standard", functions: dict | None = None, hooks: dict[str, Hook] | None = None):
        if semantics not in ("standard", "reference"):
            raise ValueError(semantics)
        self.spark, self.data, self.reference = spark, data, semantics == "reference"
        self.functions, self.hooks = functions or {}, hooks or {}
        self.decimals = False  # whether results show decimals as they are
        self.memo: dict[tuple, Solutions] = {}

    def within(self, data) -> Compiler:
        out = Compiler(self.spark, data, "reference" if self.reference else "standard", self.functions, self.hooks)
        return out

    def compile(self, n: A.Node) -> Solutions:
        for hook in self.hooks.values():
            if (out := hook(self, n)) is not None:
                return out
        return getattr(self, "n_" + type(n).__name__.lower())(n)

    def expressions(self, values: dict[str, E.Value], exists: dict | None = None) -> E.Expressions:
        return E.Expressions(values, exists, self.functions)

    # Patterns

    def n_bgp(self, n: A.BGP) -> Solutions:
        if not n.triples:
            return S.unit(self.spark)
        key = (id(self.data), frozenset(n.triples))
        if key not in self.memo:
            self.memo[key] = self.data.bgp(n.triples, self.spark)
        return self.memo[key]

    def n_path(self, n: A.Path) -> Solutions:
        return S.repeated(x, N) if N in (x := self._path(n)).kinds else x

    def _path(self, n: A.Path, other: Solutions | None = None) -> Solutions:
        """The pairs of a path, from the end that is a constant or that ``other`` binds; counted where they can repeat."""
        paths, names = Paths(self.spark, self.data), {AT: "_path_s", TO: "_path_o"} | ({N: N} if repeats(n.way) else {})

        def bound(x: Term) -> Solutions | None:
            if not isinstance(x, Var):
                if isinstance(x, BNode):
                    return None
                c, k = E.constant(x)
                return self._like_data(Solutions(self.spark.range(1).select(c.alias(column(AT))), {AT: k.sure()}))
            if other is None or x.name not in other.kinds or not other.kinds[x.name].certain:
                return None
            return Solutions(other.df.select(other.col(x.name).alias(column(AT))).distinct(), {AT: other.kinds[x.name]})

        starts, ends = bound(n.s), bound(n.o)
        if starts is None and ends is not None:
            out = swapped(paths.pairs(("^", n.way) if n.way[0] not in "+*?" else (n.way[0], ("^", n.way[1])), ends))
        else:
            out = paths.pairs(n.way, starts)
        out = renamed(out, names)
        for x, name in ((n.s, names[AT]), (n.o, names[TO])):
            if not isinstance(x, Var):
                out = Solutions(out.df.filter(E.equal((out.col(name), out.kinds[name]), E.constant(x))), out.kinds)
        if n.s == n.o:
            out = Solutions(out.df.filter(V.as_term(out.col(names[AT]), out.kinds[names[AT]]) == V.as_term(out.col(names[TO]), out.kinds[names[TO]])), out.kinds)
        kept = {name: x.name for x, name in ((n.s, names[AT]), (n.o, names[TO])) if isinstance(x, Var) and not (x == n.s and name == names[TO])}
        return renamed(out, kept | ({N: N} if N in names else {}))

    def _like_data(self, s: Solutions) -> Solutions:
        from graphloom.sources.mapping import Mapping

        return s if isinstance(self.data, Mapping) else s.to({v: V.TERM_KIND for v in s.kinds})

    def n_graph(self, n: A.Graph) -> Solutions:
        return self.within(self.data.inside(n.name)).compile(n.part)

    def n_service(self, n: A.Service) -> Solutions:
        raise NotImplementedError("SERVICE is not supported")

    def n_values(self, n: A.Values) -> Solutions:
        kinds: dict[str, Kind] = {}
        columns = []
        for i, v in enumerate(n.vars):
            own = [r[i] for r in n.rows if r[i] is not None]
            found = [E.constant(t)[1] if not isinstance(t, BNode) else V.TERM_KIND for t in own]
            kind = reduce(V.meet, found) if found else V.TERM_KIND
            kinds[v] = kind if len(own) == len(n.rows) and own else kind.maybe()
            columns.append([None if t is None else T.row(t) if kind.name == "term" else t.value if kind.name == "iri" else t.lex if kind.name == "time" else Decimal(t.lex) if kind.name == "dec" else t.native() for t in (r[i] for r in n.rows)])
        from pyspark.sql import types as ST

        raw = [ST.StringType() if kinds[v].name in ("iri", "time") else T.TERM if kinds[v].name == "term" else {"str": ST.StringType(), "int": ST.LongType(), "double": ST.DoubleType(), "dec": ST.DecimalType(37, 18), "bool": ST.BooleanType()}[kinds[v].name] for v in n.vars]
        schema = ST.StructType([ST.StructField(column(v), t) for v, t in zip(n.vars, raw, strict=True)])
        rows = [tuple(float(c[i]) if kinds[v].name == "double" and c[i] is not None else c[i] for v, c in zip(n.vars, columns, strict=True)) for i in range(len(n.rows))]
        df = self.spark.createDataFrame(rows, schema)
        times = {column(v): F.col(f"`{column(v)}`").cast("timestamp") for v in n.vars if kinds[v].name == "time"}
        return Solutions(df.withColumns(times) if times else df, kinds)

    # Joins and sets

    def n_join(self, n: A.Join) -> Solutions:
        if isinstance(n.right, A.Path):
            left = self.compile(n.left)
            out = S.join(left, self._path(n.right, left))
            return S.repeated(out, N) if N in out.kinds else out
        if not self.reference:
            for given, other in ((n.right, n.left), (n.left, n.right)):
                if isinstance(given, A.Values) and len(parts := _by_bound(given)) > 1:
                    rest = self.compile(other)
                    return reduce(S.union, (S.join(rest, self.compile(p)) for p in parts))
        return S.join(self.compile(n.left), self.compile(n.right), self.reference and not isinstance(n.right, A.BGP))

    def n_leftjoin(self, n: A.LeftJoin) -> Solutions:
        left, right = self.compile(n.left), self.compile(n.right)
        if n.expr is None:
            return S.left_join(left, right)
        if any(isinstance(e, A.Exists) for e in _walk(n.expr)):
            left, right, _ = S._meet(left, right)
            return S.optional(left, right, lambda x: self._filtered(S.join(x, right), n.expr))
        return S.left_join(left, right, lambda values: self.expressions(values).test(n.expr))

    def n_union(self, n: A.Union) -> Solutions:
        return S.union(self.compile(n.left), self.compile(n.right), self.reference)

    def n_minus(self, n: A.Minus) -> Solutions:
        return S.minus(self.compile(n.left), self.compile(n.right))

    def n_filter(self, n: A.Filter) -> Solutions:
        return self._filtered(self.compile(n.part), n.expr)

    def _filtered(self, out: Solutions, expr: A.Expr) -> Solutions:
        plain = []
        for e in A.conjuncts(expr):
            if isinstance(e, A.Exists):
                out = self._exists(out, e.pattern, e.negated)
            elif isinstance(e, A.Call) and e.name == "!" and isinstance(e.args[0], A.Exists):
                out = self._exists(out, e.args[0].pattern, not e.args[0].negated)
            else:
                plain.append(e)
        for e in plain:
            inner = list(dict.fromkeys(x for x in _walk(e) if isinstance(x, A.Exists)))
            if inner:
                out = self._flagged(out, e, inner)
            else:
                out = Solutions(out.df.filter(self.expressions(out.values()).test(e)), out.kinds)
            for v in _bound_by(e):
                if v in out.kinds:
                    out.kinds = out.kinds | {v: out.kinds[v].sure()}
        return out

    def _exists(self, out: Solutions, pattern: A.Node, negated: bool) -> Solutions:
        """Filters of the pattern that speak of outer variables stand in the join's condition."""
        outer = []
        if isinstance(pattern, A.Filter):
            own = set(A.visible(pattern.part)) | {"*exists"}
            parts = A.conjuncts(pattern.expr)
            outer = [e for e in parts if not A.free(e) <= own]
            rest = [e for e in parts if e not in outer]
            pattern = pattern.part
            if rest:
                pattern = A.Filter(reduce(lambda a, b: A.Call("&&", (a, b)), rest), pattern)
        right = self.compile(pattern)
        test = (lambda values: reduce(lambda a, b: a & b, [self.expressions(values).test(e) for e in outer])) if outer else None
        return S.semi(out, right, negated, test)

    def _flagged(self, out: Solutions, e: A.Expr, inner: list[A.Exists]) -> Solutions:
        """EXISTS below other operators: cut the rows by each, then test with constants in its place."""
        parts = [(out, {})]
        for x in inner:
            parts = [(self._exists(s, x.pattern, x.negated == holds), known | {x: F.lit(holds)}) for s, known in parts for holds in (True, False)]
        kept = [Solutions(s.df.filter(self.expressions(s.values(), known).test(e)), s.kinds) for s, known in parts]
        return reduce(S.union, kept)

    def n_extend(self, n: A.Extend) -> Solutions:
        out = self.compile(n.part)
        c, k = self.expressions(out.values()).value(n.expr)
        sure = isinstance(n.expr, A.Const) or isinstance(n.expr, A.Ref) and n.expr.var in out.kinds and out.kinds[n.expr.var].certain
        return Solutions(out.df.withColumn(column(n.var), c), out.kinds | {n.var: k.sure() if sure else k.maybe()})

    # Groups

    def n_group(self, n: A.Group) -> Solutions:
        out = self.compile(n.part)
        ex = self.expressions(out.values())
        keys = [(v, *ex.value(e)) for v, e in n.keys]
        texts = [(v, a) for v, a in n.aggs if a.name == "GROUP_CONCAT"]
        aggs = [(v, *self._aggregate(ex, out, a)) for v, a in n.aggs if a.name != "GROUP_CONCAT"]
        df = out.df.groupBy(*(c.alias(column(v)) for v, c, _ in keys))
        df = df.agg(*(c.alias(column(v)) for v, c, _ in aggs)) if aggs else df.agg(F.count(F.lit(1)).alias("_n")).drop("_n")
        for v, a in texts:
            df = self._with_text(df, out, [(k, c) for k, c, _ in keys], ex.value(a.arg), v, a)
            aggs.append((v, None, E.STR))
        kinds = {v: k if isinstance(e, A.Ref) and e.var in out.kinds and out.kinds[e.var].certain else k.maybe() for (v, _, k), (_, e) in zip(keys, n.keys, strict=True)}
        made = Solutions(df, kinds | {v: k for v, _, k in aggs})
        if self.reference and keys:
            none = self.spark.range(1).select(*(F.lit(None).cast(k.sql()).alias(column(v)) for v, k in made.kinds.items()))
            empty = none.join(made.df.select(F.lit(True).alias("_some")).limit(1), F.lit(True), "left_anti")
            made = Solutions(made.df.unionByName(empty), {v: k.maybe() for v, k in made.kinds.items()})
        return made

    def _aggregate(self, ex: E.Expressions, out: Solutions, a: A.Agg) -> tuple[Column, Kind]:
        if a.name == "COUNT":
            if a.arg is None:
                if not a.distinct:
                    return F.count(F.lit(1)), E.INT
                row = F.struct(*(out.col(v) for v in out.kinds)) if out.kinds else F.lit(1)
                return F.count_distinct(row), E.INT
            c, _ = ex.value(a.arg)
            return (F.count_distinct(c) if a.distinct else F.count(c)), E.INT
        c, k = ex.value(a.arg)
        if a.name in ("SUM", "AVG"):
            x = V.numeric(c, k)
            # One value that is no number makes the whole aggregate an error.
            wrong = F.count_if(c.isNotNull() & x.isNull()) if k.name == "term" else F.lit(0)
            kind = {"int": E.INT, "dec": E.DEC.maybe()}.get(k.name, E.DOUBLE.maybe())
            total = F.sum_distinct(x) if a.distinct else F.try_sum(x) if k.name == "dec" else F.sum(x)
            if k.name == "dec":  # null beyond the digits that fit
                total = total.try_cast(V.DECIMAL)
            total = F.when(F.count(x) == 0, F.lit(0).cast(V.NATIVE[kind.name])).otherwise(total)
            if a.name == "SUM":
                return F.when(wrong == 0, total), kind
            n = F.count_distinct(x) if a.distinct else F.count(x)
            if kind.name == "double":
                mean = F.try_divide(F.sum_distinct(x.cast("double")), n) if a.distinct else F.avg(x)
                return F.when(wrong == 0, F.coalesce(mean.cast("double"), F.lit(0.0))), kind
            return F.when(n == 0, F.lit(0).cast(V.DECIMAL)).otherwise(E.ratio(total, n)), E.DEC.maybe()
        if a.name in ("MIN", "MAX"):
            pick = F.min_by if a.name == "MIN" else F.max_by
            if k.name in V.NATIVE:
                return (F.min if a.name == "MIN" else F.max)(c), k.maybe()
            order = F.struct(*_order(c, k))
            return pick(c, F.when(c.isNotNull(), order)), k.maybe()
        if a.name == "SAMPLE":
            return F.any_value(c, F.lit(True)), k.maybe()
        raise NotImplementedError(a.name)

    def _with_text(self, df: DataFrame, out: Solutions, keys: list[tuple[str, Column]], value: E.Value, name: str, a: A.Agg) -> DataFrame:
        """GROUP_CONCAT beside other aggregates, sorted, so that the text does not depend on the order of arrival.

        Values are dealt by ranges of (group, value): a large group is sorted and joined
        in as many parts as it has ranges, and only the parts' texts meet in one place.
        """
        names = [column(k) for k, _ in keys]
        rows = out.df.select(*(c.alias(column(k)) for k, c in keys), V.lexical(*value).alias("_text")).filter("_text is not null")
        dealt = rows.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *names, "_text").withColumn("_part", F.spark_partition_id())
        held = F.collect_set("_text") if a.distinct else F.collect_list("_text")
        parts = dealt.groupBy(*names, "_part").agg(F.array_join(F.array_sort(held), a.separator).alias("_text"))
        whole = parts.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("_part", "_text"))).alias("_texts"))
        whole = whole.select(*(F.col(n).alias(f"r_{n}") for n in names), F.array_join(F.transform("_texts", lambda x: x["_text"]), a.separator).alias("_text"))
        on = reduce(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"r_{n}")) for n in names), F.lit(True))
        return df.join(whole, on, "left").select(*df.columns, F.coalesce("_text", F.lit("")).alias(column(name)))

    # Modifiers

    def n_project(self, n: A.Project) -> Solutions:
        out = self.compile(n.part)
        kinds = {v: out.kinds.get(v, Kind("str").maybe()) for v in n.vars}
        cols = [(out.col(v) if v in out.kinds else F.lit(None).cast("string")).alias(column(v)) for v in n.vars]
        return Solutions(out.df.select(*cols), kinds)

    def n_distinct(self, n: A.Distinct) -> Solutions:
        # Spark's distinct loses the order: first distinct, then sort by what is left to sort by.
        inner = n.part
        if isinstance(inner, A.Project) and isinstance(inner.part, A.OrderBy):
            keys = tuple((e, d) for e, d in inner.part.keys if A.free(e) <= set(inner.vars))
            out = self.compile(A.Project(inner.part.part, inner.vars)).distinct()
            return self._sorted(out, keys, total=False)
        return self.compile(inner).distinct()

    def n_reduced(self, n: A.Reduced) -> Solutions:
        return self.compile(n.part)

    def n_orderby(self, n: A.OrderBy) -> Solutions:
        return self._sorted(self.compile(n.part), n.keys, total=False)

    def _sorted(self, out: Solutions, keys: tuple, total: bool) -> Solutions:
        ex = self.expressions(out.values())
        by = []
        for e, descending in keys:
            c, k = ex.value(e)
            by += [x.desc_nulls_last() if descending else x.asc_nulls_first() for x in _order(c, k)]
        if total:
            by += [x.asc_nulls_first() for v, k in out.kinds.items() for x in _order(out.col(v), k)]
        return Solutions(out.df.orderBy(*by), out.kinds) if by else out

    def n_slice(self, n: A.Slice) -> Solutions:
        part = n.part
        # With a limit, ties are broken by all variables, so that the answer is always the same.
        if isinstance(part, A.Project) and isinstance(part.part, A.OrderBy):
            out = self._sorted(self.compile(part.part.part), part.part.keys, total=True)
            kinds = {v: out.kinds.get(v, Kind("str").maybe()) for v in part.vars}
            out = Solutions(out.df.select(*((out.col(v) if v in out.kinds else F.lit(None).cast("string")).alias(column(v)) for v in part.vars)), kinds)
        elif isinstance(part, A.Distinct) and isinstance(part.part, A.Project) and isinstance(part.part.part, A.OrderBy):
            inner = part.part
            keys = tuple((e, d) for e, d in inner.part.keys if A.free(e) <= set(inner.vars))
            out = self._sorted(self.compile(A.Project(inner.part.part, inner.vars)).distinct(), keys, total=True)
        else:
            out = self.compile(part)
        df = out.df.offset(n.start) if n.start else out.df
        return Solutions(df.limit(n.length) if n.length is not None else df, out.kinds)

    # Query forms

    def select(self, q: A.Query) -> DataFrame:
        """Columns named as the variables: IRIs and terms as text, other values as they are."""
        out = self.compile(q.part)
        return out.df.select(*(shown(out.col(v), out.kinds[v], self.decimals).alias(v) for v in q.vars))

    def ask(self, q: A.Query) -> DataFrame:
        return self.compile(q.part).df.select(F.lit(1).alias("one")).limit(1).agg((F.count("one") > 0).alias("answer"))

    def construct(self, q: A.Query) -> DataFrame:
        """(s, p, o) as terms, a set; blank nodes of the template are new for each solution."""
        out = self.compile(q.part)
        seed = F.to_json(F.struct(*(V.as_term(out.col(v), out.kinds[v]).alias(column(v)) for v in sorted(out.kinds)))) if out.kinds else F.lit("")

        def fill(x: Term) -> Column:
            if isinstance(x, Var):
                return V.as_term(out.col(x.name), out.kinds[x.name]) if x.name in out.kinds else F.lit(None).cast(T.TERM)
            if isinstance(x, BNode):
                return T.make(T.BNODE, F.concat(F.lit("c"), F.sha2(F.concat(seed, F.lit(f"|{x.label}")), 256)))
            return T.lit(x)

        rows = F.array(*(F.struct(fill(t.s).alias("s"), fill(t.p).alias("p"), fill(t.o).alias("o")) for t in q.template))
        made = out.df.select(F.explode(rows).alias("t")).select("t.*")
        valid = F.col("s").isNotNull() & F.col("o").isNotNull() & (F.col("s.kind") != T.LITERAL) & (F.col("p.kind") == T.IRI)
        return made.filter(valid).distinct()


def shown(c: Column, k: Kind, decimals: bool = False) -> Column:
    """How a value appears in a result: IRIs and literals by their text, blank nodes as _:label, decimals as doubles unless asked for."""
    if k.name == "dec" and not decimals:
        return c.cast("double")
    if k.name == "term":
        return F.when(c["kind"] == T.BNODE, F.concat(F.lit("_:"), c["lex"])).otherwise(c["lex"])
    return V.lexical(c, k) if k.name == "iri" else c


def _order(c: Column, k: Kind) -> list[Column]:
    """Sort keys: unbound, blank nodes, IRIs, literals; numbers by value."""
    if k.name == "term":
        return [c["kind"], V.numeric(c, k), c["lex"], c["lang"]]
    return [V.iri_text(c, k)] if k.name == "iri" else [c]


def _by_bound(n: A.Values) -> list[A.Values]:
    """The rows of VALUES by which variables they bind, each with those variables only."""
    groups: dict[tuple[int, ...], list[tuple]] = {}
    for r in n.rows:
        groups.setdefault(tuple(i for i, x in enumerate(r) if x is not None), []).append(r)
    return [A.Values(tuple(n.vars[i] for i in at), tuple(tuple(r[i] for i in at) for r in rows)) for at, rows in groups.items()]


def _walk(e: A.Expr):
    yield e
    if isinstance(e, A.Call):
        for a in e.args:
            yield from _walk(a)


def _bound_by(e: A.Expr) -> set[str]:
    """Variables that are bound wherever the filter holds."""
    if isinstance(e, A.Call) and e.name == "BOUND" and isinstance(e.args[0], A.Ref):
        return {e.args[0].var}
    if isinstance(e, A.Call) and e.name in ("=", "<", ">", "<=", ">=", "!=", "IN"):
        return {a.var for a in e.args[:1 if e.name == "IN" else 2] if isinstance(a, A.Ref)}
    return set()

