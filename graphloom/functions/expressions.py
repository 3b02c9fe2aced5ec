"""SPARQL expressions as columns.  An error is null, so that Spark's three-valued logic is SPARQL's."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions import values as V
from graphloom.functions.terms import XSD, Iri, Literal
from graphloom.functions.values import Kind
from graphloom.plans.algebra import Call, Const, Exists, Expr, Ref

BOOL, STR, INT, DEC, DOUBLE, TIME = (Kind(n) for n in ("bool", "str", "int", "dec", "double", "time"))
Value = tuple[Column, Kind]


def constant(t: Iri | Literal) -> Value:
    if isinstance(t, Iri):
        return F.lit(t.value), V.FULL_IRI
    if t.lang or t.dt not in (None, XSD + "string", XSD + "boolean", XSD + "dateTime", XSD + "date", *T.NUMERIC):
        return T.lit(t), V.TERM_KIND
    if t.dt in (XSD + "dateTime", XSD + "date"):
        return F.lit(t.lex).try_cast("timestamp"), TIME
    if t.dt == XSD + "decimal" and (exact := decimal(t.lex)) is not None:
        return F.lit(exact).cast(V.DECIMAL), DEC
    v = t.native()
    kind = BOOL if t.dt == XSD + "boolean" else STR if t.dt in (None, XSD + "string") else INT if isinstance(v, int) else DOUBLE
    return F.lit(v).cast(V.NATIVE[kind.name]), kind


def decimal(text: str) -> Decimal | None:
    """An exact value that decimal columns can hold."""
    try:
        d = Decimal(text)
    except InvalidOperation:
        return None
    if not d.is_finite():
        return None
    _, digits, exponent = d.as_tuple()
    return d if -exponent <= 18 and len(digits) + exponent <= 19 else None


def plus(x: Column, y: Column, name: str) -> Column:
    """Exact sums, differences and products; null beyond the digits that fit."""
    x, y = x.cast(V.DECIMAL), y.cast(V.DECIMAL)
    if name != "*":
        return (F.try_add if name == "+" else F.try_subtract)(x, y).try_cast(V.DECIMAL)
    # Factors of few digits, whose exact product has 18 digits after the point.
    out = F.lit(None).cast(V.DECIMAL)
    for left, right in (("decimal(27,18)", "decimal(10,0)"), ("decimal(10,0)", "decimal(27,18)"), ("decimal(19,9)", "decimal(18,9)")):
        a, b = x.try_cast(left), y.try_cast(right)
        out = F.coalesce(out, F.when((a == x) & (b == y), F.try_multiply(a, b).try_cast(V.DECIMAL)))
    return F.coalesce(out, F.try_multiply(x, y).try_cast(V.DECIMAL))


def ratio(x: Column, y: Column) -> Column:
    """A quotient to 18 digits after the point, as far as both have nine at most; else to six."""
    x, y = x.cast(V.DECIMAL), y.cast(V.DECIMAL)
    a, b = x.try_cast("decimal(20,9)"), y.try_cast("decimal(19,9)")
    return F.when((a == x) & (b == y), F.try_divide(a, b).try_cast(V.DECIMAL)).otherwise(F.try_divide(x, y).try_cast(V.DECIMAL))


def ebv(c: Column, k: Kind) -> Column:
    """Effective boolean value; null if there is none."""
    if k.name == "bool":
        return c
    if k.name == "str":
        return F.length(c) > 0
    if k.name in V.NUMBERS:
        return (c != 0) & ~F.isnan(c.cast("double"))
    if k.name == "term":
        number = V.numeric(c, k)
        return F.when(c["dt"] == XSD + "boolean", c["lex"].isin("true", "1")).when(c["dt"] == XSD + "string", F.length(c["lex"]) > 0).when(number.isNotNull(), (number != 0) & ~F.isnan(number))
    return F.lit(None).cast("boolean")


def _text(v: Value) -> Column:
    """A string literal's text; null for other values."""
    c, k = v
    if k.name == "term":
        return F.when((c["kind"] == T.LITERAL) & (c["lang"].isNotNull() | (c["dt"] == XSD + "string")), c["lex"])
    return c if k.name == "str" else F.lit(None).cast("string")


def _like(v: Value, text: Column) -> Value:
    """A string of the same language as the argument's."""
    c, k = v
    if k.name == "term":
        return F.when(text.isNotNull(), F.struct(c["kind"].alias("kind"), text.alias("lex"), c["dt"].alias("dt"), c["lang"].alias("lang"))), V.TERM_KIND
    return text, STR


def _time(v: Value) -> Column:
    c, k = v
    if k.name == "time":
        return c
    if k.name == "term":
        return F.when(c["dt"].isin(XSD + "dateTime", XSD + "date"), c["lex"].try_cast("timestamp"))
    return F.lit(None).cast("timestamp")


def equal(a: Value, b: Value) -> Column:
    (x, p), (y, q) = a, b
    numbers = set(V.NUMBERS)
    if p.name in numbers and q.name in numbers or p.like(q) and p.name != "term":
        return x == y
    if p.name == q.name == "iri":
        return V.iri_text(x, p) == V.iri_text(y, q)
    if "term" not in (p.name, q.name):
        return F.when(x.isNotNull() & y.isNotNull(), F.lit(False))
    if p.name in numbers or q.name in numbers:
        return V.numeric(x, p) == V.numeric(y, q)
    s, t = V.as_term(x, p), V.as_term(y, q)
    return F.coalesce(V.numeric(s, V.TERM_KIND) == V.numeric(t, V.TERM_KIND), s == t)


def less(a: Value, b: Value, strict: bool) -> Column:
    """a < b or a <= b; null between values that have no order."""
    op: Callable[[Column, Column], Column] = (lambda x, y: x < y) if strict else (lambda x, y: x <= y)
    (x, p), (y, q) = a, b
    numbers = set(V.NUMBERS)
    if p.name in numbers and q.name in numbers or p.name == q.name and p.name in ("str", "bool", "time"):
        return op(x, y)
    if "term" in (p.name, q.name):
        tried = [op(V.numeric(x, p), V.numeric(y, q)), op(_text(a), _text(b)), op(_time(a), _time(b))]
        return F.coalesce(*tried)
    return F.lit(None).cast("boolean")


def _regex_flags(flags: Column | None) -> Column:
    return F.lit("") if flags is None else F.when(F.length(flags) > 0, F.concat(F.lit("(?"), F.replace(flags, F.lit("q"), F.lit("")), F.lit(")"))).otherwise("")


class Expressions:
    """Compiles expressions over the variables of one solution table."""

    def __init__(self, bound: dict[str, Value], exists: dict[Exists, Column] | None = None, functions: dict[str, Callable[..., Column]] | None = None):
        self.bound, self.exists, self.functions = bound, exists or {}, functions or {}

    def value(self, e: Expr) -> Value:
        if isinstance(e, Ref):
            return self.bound.get(e.var, (F.lit(None).cast("string"), STR.maybe()))
        if isinstance(e, Const):
            return constant(e.term)
        if isinstance(e, Exists):
            return self.exists[e], BOOL
        if isinstance(e, Call):
            return self.call(e.name, e.args)
        raise NotImplementedError(f"{type(e).__name__} is not allowed here")

    def test(self, e: Expr) -> Column:
        return ebv(*self.value(e))

    def call(self, name: str, args: tuple[Expr, ...]) -> Value:
        if name == "&&":
            return self.test(args[0]) & self.test(args[1]), BOOL
        if name == "||":
            return self.test(args[0]) | self.test(args[1]), BOOL
        if name == "!":
            return ~self.test(args[0]), BOOL
        if name == "BOUND":
            return self.value(args[0])[0].isNotNull(), BOOL
        if name == "IF":
            return self._choose([(self.test(args[0]), self.value(args[1])), (~self.test(args[0]), self.value(args[2]))])
        if name == "COALESCE":
            found = [self.value(a) for a in args]
            return self._choose([(c.isNotNull(), (c, k)) for c, k in found])
        v = [self.value(a) for a in args]
        if name in ("=", "!="):
            return (equal(*v) if name == "=" else ~equal(*v)), BOOL
        if name in ("<", "<="):
            return less(v[0], v[1], name == "<"), BOOL
        if name in (">", ">="):
            return less(v[1], v[0], name == ">"), BOOL
        if name == "IN":
            out = F.lit(False)
            for other in v[1:]:
                out = out | equal(v[0], other)
            return out, BOOL
        if name == "SAMETERM":
            return V.as_term(*v[0]) == V.as_term(*v[1]), BOOL
        if name in ("+", "-", "*", "/"):
            x, y = V.numeric(*v[0]), V.numeric(*v[1])
            kinds = {v[0][1].name, v[1][1].name}
            if name == "/":
                return (ratio(x, y), DEC) if kinds <= {"int", "dec"} else (F.try_divide(x.cast("double"), y.cast("double")), DOUBLE)
            if "dec" in kinds and kinds <= {"int", "dec"}:
                return plus(x, y, name), DEC
            op = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[name]
            return (op(x, y), INT) if kinds == {"int"} else (op(x.cast("double"), y.cast("double")), DOUBLE)
        if name == "neg":
            x = V.numeric(*v[0])
            return (-x).cast(V.NATIVE[v[0][1].name]) if v[0][1].name == "dec" else -x, {"int": INT, "dec": DEC}.get(v[0][1].name, DOUBLE)
        if name in self.functions:
            return self.functions[name](*(V.lexical(c, k) if k.name in ("term", "iri") else c for c, k in v)), STR
        found = getattr(self, "f_" + name.lower(), None) if ":" not in name else None
        if found is not None:
            return found(*v)
        if name.startswith(XSD):
            return self._cast(name.removeprefix(XSD), v[0])
        raise NotImplementedError(f"function {name}")

    def _choose(self, options: list[tuple[Column, Value]]) -> Value:
        kind = options[0][1][1]
        for _, (_, k) in options[1:]:
            kind = V.meet(kind, k)
        out = None
        for when, (c, k) in options:
            c = V.convert(c, k, kind)
            out = F.when(when, c) if out is None else out.when(when, c)
        return out, kind.maybe()

    def _cast(self, name: str, v: Value) -> Value:
        c, k = v
        text = V.lexical(c, k)
        if name == "string":
            return text, STR
        if name == "boolean":
            number = V.numeric(c, k)
            return (c if k.name == "bool" else F.when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False)).otherwise(number != 0)), BOOL
        if name == "decimal":  # a double by its shortest text, so 0.1 is a tenth
            return (c.cast("int") if k.name == "bool" else c if k.name in ("int", "dec") else F.trim(text)).try_cast(V.DECIMAL), DEC
        if name in ("double", "float"):
            return (c.cast("double") if k.name in ("int", "dec", "double", "bool") else text.try_cast("double")), DOUBLE
        if name in ("integer", "int", "long"):
            if k.name in ("int", "dec", "double", "bool"):
                return (c.cast("int") if k.name == "bool" else c).try_cast("bigint"), INT
            return F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint")), INT
        if name in ("dateTime", "date"):
            return (c if k.name == "time" else text.try_cast("timestamp")), TIME
        raise NotImplementedError(f"cast to xsd:{name}")

    # Terms

    def f_isiri(self, v: Value) -> Value:
        c, k = v
        return (c["kind"] == T.IRI if k.name == "term" else F.when(c.isNotNull(), F.lit(k.name == "iri"))), BOOL

    f_isuri = f_isiri

    def f_isblank(self, v: Value) -> Value:
        c, k = v
        return (c["kind"] == T.BNODE if k.name == "term" else F.when(c.isNotNull(), F.lit(False))), BOOL

    def f_isliteral(self, v: Value) -> Value:
        c, k = v
        return (c["kind"] == T.LITERAL if k.name == "term" else F.when(c.isNotNull(), F.lit(k.name != "iri"))), BOOL

    def f_isnumeric(self, v: Value) -> Value:
        c, k = v
        return (V.numeric(c, k).isNotNull() & c.isNotNull() if k.name == "term" else F.when(c.isNotNull(), F.lit(k.name in V.NUMBERS))), BOOL

    def f_str(self, v: Value) -> Value:
        return V.lexical(*v), STR

    def f_lang(self, v: Value) -> Value:
        c, k = v
        return (F.when(c["kind"] == T.LITERAL, F.coalesce(c["lang"], F.lit(""))) if k.name == "term" else F.when(c.isNotNull() & F.lit(k.name != "iri"), F.lit(""))), STR

    def f_langmatches(self, tag: Value, range_: Value) -> Value:
        t, r = F.lower(_text(tag)), F.lower(_text(range_))
        return F.when(r == "*", F.length(t) > 0).otherwise((t == r) | F.startswith(t, F.concat(r, F.lit("-")))), BOOL

    def f_datatype(self, v: Value) -> Value:
        c, k = v
        if k.name == "term":
            return F.when(c["kind"] == T.LITERAL, F.when(c["lang"].isNotNull(), F.lit(T.RDF + "langString")).otherwise(c["dt"])), V.FULL_IRI
        return F.when(c.isNotNull(), F.lit(V.DATATYPE.get(k.name))), V.FULL_IRI

    def f_iri(self, v: Value) -> Value:
        return V.lexical(*v), V.FULL_IRI

    f_uri = f_iri

    def f_bnode(self, v: Value | None = None) -> Value:
        return T.make(T.BNODE, F.uuid() if v is None else F.concat(F.lit("b"), F.sha1(_text(v)))), V.TERM_KIND

    def f_strdt(self, v: Value, dt: Value) -> Value:
        return T.make(T.LITERAL, _text(v), V.lexical(*dt)), V.TERM_KIND

    def f_strlang(self, v: Value, lang: Value) -> Value:
        return T.make(T.LITERAL, _text(v), None, F.lower(_text(lang))), V.TERM_KIND

    def f_uuid(self) -> Value:
        return F.concat(F.lit("urn:uuid:"), F.uuid()), V.FULL_IRI

    def f_struuid(self) -> Value:
        return F.uuid(), STR

    # Strings

    def f_strlen(self, v: Value) -> Value:
        return F.length(_text(v)).cast("bigint"), INT

    def f_ucase(self, v: Value) -> Value:
        return _like(v, F.upper(_text(v)))

    def f_lcase(self, v: Value) -> Value:
        return _like(v, F.lower(_text(v)))

    def f_substr(self, v: Value, start: Value, length: Value | None = None) -> Value:
        s = V.numeric(*start).cast("int")
        n = V.numeric(*length).cast("int") if length else F.length(_text(v)) + 1
        end = (s + n) if length else F.length(_text(v)) + 1
        return _like(v, F.substring(_text(v), F.greatest(s, F.lit(1)), F.greatest(end - F.greatest(s, F.lit(1)), F.lit(0))))

    def f_strstarts(self, a: Value, b: Value) -> Value:
        return F.startswith(_text(a), _text(b)), BOOL

    def f_strends(self, a: Value, b: Value) -> Value:
        return F.endswith(_text(a), _text(b)), BOOL

    def f_contains(self, a: Value, b: Value) -> Value:
        return F.contains(_text(a), _text(b)), BOOL

    def f_strbefore(self, a: Value, b: Value) -> Value:
        at = F.call_function("locate", _text(b), _text(a))
        return F.when(at > 0, F.substring(_text(a), F.lit(1), at - 1)).when(at == 0, F.lit("")), STR

    def f_strafter(self, a: Value, b: Value) -> Value:
        at = F.call_function("locate", _text(b), _text(a))
        return F.when(at > 0, F.substring(_text(a), at + F.length(_text(b)), F.length(_text(a)))).when(at == 0, F.lit("")), STR

    def f_encode_for_uri(self, v: Value) -> Value:
        text = F.url_encode(_text(v))
        for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            text = F.replace(text, F.lit(a), F.lit(b))
        return text, STR

    def f_concat(self, *vs: Value) -> Value:
        return F.concat(*(_text(v) for v in vs)) if vs else F.lit(""), STR

    def f_regex(self, v: Value, pattern: Value, flags: Value | None = None) -> Value:
        return F.regexp_like(_text(v), F.concat(_regex_flags(_text(flags) if flags else None), _text(pattern))), BOOL

    def f_replace(self, v: Value, pattern: Value, to: Value, flags: Value | None = None) -> Value:
        p = F.concat(_regex_flags(_text(flags) if flags else None), _text(pattern))
        return _like(v, F.call_function("regexp_replace", _text(v), p, _text(to)))

    # Numbers, times, digests

    def _keep(self, v: Value, f: Callable[[Column], Column]) -> Value:
        x = V.numeric(*v)
        if v[1].name == "dec":
            return f(x).try_cast(V.DECIMAL), DEC
        return (f(x).cast("bigint"), INT) if v[1].name == "int" else (f(x).cast("double"), DOUBLE)

    def f_abs(self, v: Value) -> Value:
        return self._keep(v, F.abs)

    def f_ceil(self, v: Value) -> Value:
        return self._keep(v, F.ceil)

    def f_floor(self, v: Value) -> Value:
        return self._keep(v, F.floor)

    def f_round(self, v: Value) -> Value:
        half = F.lit(Decimal("0.5")) if v[1].name == "dec" else 0.5
        return self._keep(v, lambda x: F.floor(x + half))

    def f_rand(self) -> Value:
        return F.rand(), DOUBLE

    def f_now(self) -> Value:
        return F.current_timestamp(), TIME

    def f_year(self, v: Value) -> Value:
        return F.year(_time(v)).cast("bigint"), INT

    def f_month(self, v: Value) -> Value:
        return F.month(_time(v)).cast("bigint"), INT

    def f_day(self, v: Value) -> Value:
        return F.dayofmonth(_time(v)).cast("bigint"), INT

    def f_hours(self, v: Value) -> Value:
        return F.hour(_time(v)).cast("bigint"), INT

    def f_minutes(self, v: Value) -> Value:
        return F.minute(_time(v)).cast("bigint"), INT

    def f_seconds(self, v: Value) -> Value:
        return F.date_part(F.lit("SECOND"), _time(v)).cast("double"), DOUBLE

    def f_tz(self, v: Value) -> Value:
        c, k = v
        if k.name == "term":
            return F.when(_time(v).isNotNull(), F.regexp_extract(c["lex"], r"(Z|[+-][0-9]{2}:[0-9]{2})$", 1)), STR
        return F.when(_time(v).isNotNull(), F.lit("")), STR

    def f_timezone(self, v: Value) -> Value:
        tz, _ = self.f_tz(v)
        hours = F.regexp_extract(tz, "([0-9]{2}):", 1).try_cast("int")
        minutes = F.regexp_extract(tz, ":([0-9]{2})", 1).try_cast("int")
        text = F.concat(F.when(F.startswith(tz, F.lit("-")), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
        text = F.when(tz == "Z", "PT0S").when(tz != "", F.when((hours == 0) & (minutes == 0), "PT0S").otherwise(text))
        return T.make(T.LITERAL, text, XSD + "dayTimeDuration"), V.TERM_KIND

    def f_md5(self, v: Value) -> Value:
        return F.md5(_text(v).cast("binary")), STR

    def f_sha1(self, v: Value) -> Value:
        return F.sha1(_text(v).cast("binary")), STR

    def f_sha256(self, v: Value) -> Value:
        return F.sha2(_text(v).cast("binary"), 256), STR

    def f_sha384(self, v: Value) -> Value:
        return F.sha2(_text(v).cast("binary"), 384), STR

    def f_sha512(self, v: Value) -> Value:
        return F.sha2(_text(v).cast("binary"), 512), STR
