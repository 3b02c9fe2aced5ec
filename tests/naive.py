"""A plain SPARQL evaluator over lists of triples, straight from the definitions.

Solutions are dicts; nothing is clever.  It reads the same algebra as the engine
and serves as its peer on small random graphs.
"""

from __future__ import annotations

import itertools
import re

from graphloom.functions.terms import NUMERIC, XSD, BNode, Iri, Literal, Var
from graphloom.plans import algebra as A


class Wrong(Exception):
    """An expression's error."""


def compatible(a, b):
    return all(b[v] == x for v, x in a.items() if v in b)


def number(x):
    if isinstance(x, Literal) and x.dt in NUMERIC:
        return float(x.lex)
    raise Wrong


def truth(x):
    if isinstance(x, Literal):
        if x.dt == XSD + "boolean":
            return x.lex == "true"
        if x.dt in (None, XSD + "string") and not x.lang:
            return bool(x.lex)
        return number(x) != 0
    raise Wrong


def boolean(b):
    return Literal("true" if b else "false", XSD + "boolean")


def value(e, mu, ctx):
    if isinstance(e, A.Ref):
        if e.var not in mu:
            raise Wrong
        return mu[e.var]
    if isinstance(e, A.Const):
        return e.term
    if isinstance(e, A.Exists):
        return boolean(any(compatible(mu, nu) for nu in evaluate(e.pattern, ctx, mu)) != e.negated)
    name, args = e.name, e.args
    if name in ("&&", "||"):
        got = []
        for a in args:
            try:
                got.append(truth(value(a, mu, ctx)))
            except Wrong:
                got.append(None)
        if name == "&&":
            if False in got:
                return boolean(False)
            if None in got:
                raise Wrong
            return boolean(True)
        if True in got:
            return boolean(True)
        if None in got:
            raise Wrong
        return boolean(False)
    if name == "!":
        return boolean(not truth(value(args[0], mu, ctx)))
    if name == "BOUND":
        return boolean(args[0].var in mu)
    if name == "COALESCE":
        for a in args:
            try:
                return value(a, mu, ctx)
            except Wrong:
                continue
        raise Wrong
    v = [value(a, mu, ctx) for a in args]
    if name in ("=", "!="):
        try:
            same = number(v[0]) == number(v[1])
        except Wrong:
            same = v[0] == v[1]
        return boolean(same == (name == "="))
    if name in ("<", ">", "<=", ">="):
        try:
            x, y = number(v[0]), number(v[1])
        except Wrong:
            if not all(isinstance(z, Literal) and z.dt is None and not z.lang for z in v):
                raise
            x, y = v[0].lex, v[1].lex
        return boolean({"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[name])
    if name == "+":
        return Literal(str(int(number(v[0]) + number(v[1]))), XSD + "integer")
    if name == "ISIRI":
        return boolean(isinstance(v[0], Iri))
    if name == "STR":
        if isinstance(v[0], BNode):
            raise Wrong
        return Literal(v[0].value if isinstance(v[0], Iri) else v[0].lex)
    if name == "REGEX":
        return boolean(re.search(v[1].lex, v[0].lex) is not None)
    raise NotImplementedError(name)


def passes(e, mu, ctx):
    try:
        return truth(value(e, mu, ctx))
    except Wrong:
        return False


def evaluate(n, triples, outer=None):
    if isinstance(n, A.BGP):
        out = [{}]
        for t in n.triples:
            step = []
            for mu in out:
                for row in triples:
                    nu, ok = dict(mu), True
                    for x, y in zip(t, row, strict=True):
                        if isinstance(x, Var):
                            ok = nu.setdefault(x.name, y) == y
                        else:
                            ok = x == y
                        if not ok:
                            break
                    if ok:
                        step.append(nu)
            out = step
        return out
    if isinstance(n, A.Join):
        return [a | b for a, b in itertools.product(evaluate(n.left, triples), evaluate(n.right, triples)) if compatible(a, b)]
    if isinstance(n, A.LeftJoin):
        out = []
        right = evaluate(n.right, triples)
        for a in evaluate(n.left, triples):
            found = [a | b for b in right if compatible(a, b) and (n.expr is None or passes(n.expr, a | b, triples))]
            out += found or [a]
        return out
    if isinstance(n, A.Filter):
        return [mu for mu in evaluate(n.part, triples) if passes(n.expr, mu | (outer or {}), triples)]
    if isinstance(n, A.Union):
        return evaluate(n.left, triples) + evaluate(n.right, triples)
    if isinstance(n, A.Minus):
        right = evaluate(n.right, triples)
        return [a for a in evaluate(n.left, triples) if not any(compatible(a, b) and set(a) & set(b) for b in right)]
    if isinstance(n, A.Extend):
        out = []
        for mu in evaluate(n.part, triples):
            try:
                out.append(mu | {n.var: value(n.expr, mu, triples)})
            except Wrong:
                out.append(mu)
        return out
    if isinstance(n, A.Values):
        return [{v: x for v, x in zip(n.vars, r, strict=True) if x is not None} for r in n.rows]
    if isinstance(n, A.Project):
        return [{v: mu[v] for v in n.vars if v in mu} for mu in evaluate(n.part, triples)]
    if isinstance(n, A.Distinct):
        out = []
        for mu in evaluate(n.part, triples):
            if mu not in out:
                out.append(mu)
        return out
    raise NotImplementedError(type(n).__name__)
