"""Resources by IRI: HTTP with content negotiation, own loaders, URL rules, RDF/XML.

A loader takes (uri, format) and gives (text, headers), or None to leave the
resource to HTTP.  ``dereference`` loads many resources at once on the executors.
"""

from __future__ import annotations

import re
import urllib.error
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from urllib.parse import parse_qs, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as ST

from graphloom.functions import terms
from graphloom.functions.terms import RDF, RDF_TYPE, BNode, Iri, Literal, Term
from graphloom.sources.fragments import ttl_of
from graphloom.sources.triples import SCHEMA
from graphloom.sources.turtle import parse_turtle

TTL_SCHEMA = ST.StructType([*SCHEMA.fields, ST.StructField("ttl", ST.LongType())])
FORMATS = {"turtle": "text/turtle", "xml": "application/rdf+xml"}
TIMEOUT = 30
XML = "{http://www.w3.org/XML/1998/namespace}"
Loader = Callable[[str, str], "tuple[str, dict[str, str]] | None"]


def http_get(uri: str, format_: str, timeout: float = TIMEOUT) -> tuple[str, dict[str, str]] | bool:
    """(text, headers); False: this format is not served; True: no format will be."""
    request = urllib.request.Request(uri, headers={"Accept": FORMATS[format_]})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.read().decode("utf-8", "replace"), dict(r.headers)
    except urllib.error.HTTPError as e:
        return e.code != 406
    except (OSError, ValueError):
        return True


def parse_rdf(text: str, format_: str, headers: dict[str, str] | None = None, base: str = "") -> list[tuple[Term, Term, Term]] | bool:
    """Triples of a document, in the format that its Content-Type says; False if it is not well-formed."""
    said = next((v for k, v in (headers or {}).items() if k.lower() == "content-type"), "").split(";")[0].strip()
    format_ = next((f for f, t in FORMATS.items() if t == said), "turtle" if said == "application/n-triples" else format_)
    try:
        return parse_turtle(text, base)[0] if format_ == "turtle" else parse_rdfxml(text, base)
    except (ValueError, ET.ParseError):
        return False


def parse_rdfxml(text: str, base: str = "") -> list[tuple[Term, Term, Term]]:
    """The triples of an RDF/XML document."""
    out: list[tuple[Term, Term, Term]] = []
    count = iter(range(10**9))
    name = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag
    rdf = lambda x: f"{{{RDF}}}{x}"

    def iri(x: str, b: str) -> Iri:
        return Iri(urljoin(b, x) if b else x)

    def fresh() -> BNode:
        return BNode(f"x{next(count)}")

    def node(e: ET.Element, b: str, lang: str | None) -> Term:
        b, lang = e.get(XML + "base", b), e.get(XML + "lang", lang)
        if (about := e.get(rdf("about"))) is not None:
            s: Term = iri(about, b)
        elif (own := e.get(rdf("ID"))) is not None:
            s = iri("#" + own, b)
        elif (label := e.get(rdf("nodeID"))) is not None:
            s = BNode(label)
        else:
            s = fresh()
        if e.tag != rdf("Description"):
            out.append((s, Iri(RDF_TYPE), Iri(name(e.tag))))
        for k, v in e.attrib.items():
            if k.startswith(XML) or k in (rdf("about"), rdf("ID"), rdf("nodeID")):
                continue
            out.append((s, Iri(RDF_TYPE), iri(v, b)) if k == rdf("type") else (s, Iri(name(k)), Literal(v, None, lang)))
        items = iter(range(1, 10**9))
        for c in e:
            prop(s, c, b, lang, items)
        return s

    def prop(s: Term, e: ET.Element, b: str, lang: str | None, items: Iterator[int]) -> None:
        b, lang = e.get(XML + "base", b), e.get(XML + "lang", lang)
        p = Iri(f"{RDF}_{next(items)}") if e.tag == rdf("li") else Iri(name(e.tag))
        kind = e.get(rdf("parseType"))
        if (to := e.get(rdf("resource"))) is not None:
            o: Term = iri(to, b)
        elif (label := e.get(rdf("nodeID"))) is not None:
            o = BNode(label)
        elif kind == "Resource":
            o = fresh()
            own = iter(range(1, 10**9))
            out.append((s, p, o))
            for c in e:
                prop(o, c, b, lang, own)
            return
        elif kind == "Collection":
            parts = [node(c, b, lang) for c in e]
            o = Iri(RDF + "nil")
            for x in reversed(parts):
                cell = fresh()
                out.extend([(cell, Iri(RDF + "first"), x), (cell, Iri(RDF + "rest"), o)])
                o = cell
        elif kind == "Literal":
            o = Literal((e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e), RDF + "XMLLiteral")
        elif len(e):
            o = node(e[0], b, lang)
        else:
            rest = {k: v for k, v in e.attrib.items() if not k.startswith(XML) and k != rdf("datatype")}
            if rest and e.get(rdf("datatype")) is None and not (e.text or "").strip():
                o = fresh()
                for k, v in rest.items():
                    out.append((o, Iri(name(k)), Literal(v, None, lang)))
            else:
                dt = e.get(rdf("datatype"))
                o = Literal(e.text or "", iri(dt, b).value if dt else None, None if dt else lang)
        out.append((s, p, o))

    root = ET.fromstring(text)
    b, lang = root.get(XML + "base", base), root.get(XML + "lang")
    for e in root if root.tag == rdf("RDF") else [root]:
        node(e, b, lang)
    return out


def load(uri: str, loader: Loader | None = None, first: str = "turtle") -> tuple[list[tuple[Term, Term, Term]], int | None, str | None]:
    """(triples, seconds to keep, the format that worked) of one resource; without triples if none did."""
    for format_ in [first, *(f for f in FORMATS if f != first)]:
        got = loader(uri, format_) if loader else None
        got = http_get(uri, format_) if got is None else got
        if got is True:
            break
        if got is False:
            continue
        triples = parse_rdf(got[0], format_, got[1], uri)
        if triples is not False:
            return triples, ttl_of(got[1]), format_
    return [], None, None


class ResourceWrapper:
    """Functions as resources: a rule such as ``/people/<name>`` routes an IRI of a host to a function."""

    def __init__(self, host: str):
        self.host = host.rstrip("/")
        self.rules: list[tuple[re.Pattern, Callable]] = []

    def intercept(self, rule: str) -> Callable[[Callable], Callable]:
        pattern = re.compile(re.sub(r"<(\w+)>", r"(?P<\1>[^/]+)", rule) + r"\Z")

        def keep(f: Callable) -> Callable:
            self.rules.append((pattern, f))
            return f

        return keep

    def __call__(self, uri: str, format_: str) -> tuple[str, dict[str, str]] | None:
        """A loader: the function's (text, headers), with path parts and query arguments as arguments."""
        u, own = urlsplit(uri), urlsplit(self.host)
        if (u.scheme, u.hostname, u.port) != (own.scheme, own.hostname, own.port):
            return None
        for pattern, f in self.rules:
            if m := pattern.match(u.path.removeprefix(own.path)):
                return f(**m.groupdict(), **{k: v[0] for k, v in parse_qs(u.query).items()})
        return None


def dereference(uris: DataFrame, loader: Loader | None = None, with_ttl: bool = False) -> DataFrame:
    """(g, s, p, o) of the resources named in the first column, loaded in parallel; g is the resource.

    Blank nodes are told apart by resource; what can't be loaded has no rows.
    ``with_ttl`` adds the seconds for which the resource may be kept, null if its
    headers don't say.
    """
    column = uris.columns[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, first = ("kind", "lex", "dt", "lang"), "turtle"
        for pdf in batches:
            rows = []
            for uri in pdf[column]:
                triples, ttl, worked = load(uri, loader, first)
                first = worked or first
                own = lambda x, uri=uri: BNode(f"{x.label}_{uri.encode().hex()}") if isinstance(x, BNode) else x
                rows += [{"g": uri, "s": dict(zip(names, terms.row(own(s)), strict=True)), "p": p.value, "o": dict(zip(names, terms.row(own(o)), strict=True)), "ttl": ttl} for s, p, o in triples]
            out = pd.DataFrame(rows, columns=["g", "s", "p", "o", "ttl"]).astype({"ttl": "Int64"})
            yield out if with_ttl else out.drop(columns="ttl")

    return uris.select(column).distinct().mapInPandas(run, TTL_SCHEMA if with_ttl else SCHEMA)
