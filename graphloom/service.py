"""The engine over HTTP, and a client for it; only the standard library is used.

GET /sparql?query=, /fragment?query= (or agp=), /plan?agp=, /vocabs, /vocabs/ID,
/types, /types/NAME, /properties, /properties/NAME, /prefixes, /seeds, /seeds/TYPE,
/seeds/TYPE/digest, /paths/TYPE, /resources; POST /vocabs, /seeds, /prefixes, /plan;
PUT /vocabs/ID; DELETE /vocabs/ID, /seeds/id/ID.  Names may be IRIs or prefixed.
"""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from graphloom.operators.paths import Navigator
from graphloom.operators.vocabulary import Duplicate, NotFound, VocabularyError
from graphloom.plans.agp import parse_agp
from graphloom.plans.compiler import Compiler
from graphloom.session import Session
from graphloom.sources.fragments import ResourceCache
from graphloom.sources.results import json_lines, quad_text


class Service:
    """Answers requests for one session; ``start`` serves until ``stop``."""

    def __init__(self, session: Session, host: str = "127.0.0.1", port: int = 0, resources: ResourceCache | None = None):
        self.session, self.resources = session, resources
        self.lock = threading.RLock()
        service = self

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def log_message(self, *_):
                pass

            def _serve(self) -> None:
                size = int(self.headers.get("Content-Length") or 0)
                service.handle(self, self.command, self.path, self.rfile.read(size).decode() if size else "")

            do_GET = do_POST = do_PUT = do_DELETE = _serve  # noqa: N815

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.url = f"http://{host}:{self.server.server_address[1]}"

    def start(self) -> Service:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()

    def handle(self, request: BaseHTTPRequestHandler, method: str, target: str, body: str) -> None:
        u = urllib.parse.urlsplit(target)
        args = {k: v[0] for k, v in urllib.parse.parse_qs(u.query).items()}
        parts = [urllib.parse.unquote(p) for p in u.path.strip("/").split("/")]
        try:
            out = self.answer(method, parts, args, body)
        except NotFound as e:
            return self._send(request, 404, "application/json", json.dumps({"error": str(e)}))
        except Duplicate as e:
            return self._send(request, 409, "application/json", json.dumps({"error": str(e)}))
        except (VocabularyError, ValueError, KeyError, NotImplementedError) as e:
            return self._send(request, 400, "application/json", json.dumps({"error": str(e)}))
        if isinstance(out, tuple):
            kind, content = out
            return self._send(request, 200, kind, content) if isinstance(content, str) else self._stream(request, kind, content)
        return self._send(request, 200, "application/json", json.dumps(out))

    @staticmethod
    def _send(request: BaseHTTPRequestHandler, code: int, kind: str, text: str) -> None:
        data = text.encode()
        request.send_response(code)
        request.send_header("Content-Type", kind)
        request.send_header("Content-Length", str(len(data)))
        request.end_headers()
        request.wfile.write(data)

    @staticmethod
    def _stream(request: BaseHTTPRequestHandler, kind: str, pieces: Iterator[str]) -> None:
        """Piece by piece; a client that hangs up ends the job."""
        request.send_response(200)
        request.send_header("Content-Type", kind)
        request.send_header("Transfer-Encoding", "chunked")
        request.end_headers()
        try:
            for p in pieces:
                data = p.encode()
                if data:
                    request.wfile.write(b"%x\r\n%s\r\n" % (len(data), data))
            request.wfile.write(b"0\r\n\r\n")
        except (BrokenPipeError, ConnectionResetError):
            close = getattr(pieces, "close", None)
            if close:
                close()

    def _name(self, text: str) -> str:
        """An IRI from an IRI or a prefixed name."""
        prefix, _, local = text.partition(":")
        known = self.session.vocab.prefixes | self.session.prefixes
        return known[prefix] + local if prefix in known and not local.startswith("//") else text

    def answer(self, method: str, parts: list[str], args: dict[str, str], body: str):
        s, v = self.session, self.session.vocab
        match method, parts:
            case "GET", ["sparql"]:
                q = s.parse(args["query"])
                if q.form == "ask":
                    return {"head": {}, "boolean": s.sparql(args["query"]).first()[0]}
                if q.form == "construct":
                    return "application/n-triples", (r[0] + "\n" for r in quad_text(s.sparql(args["query"]).selectExpr("'' tp", "s", "p.lex p", "o"), "n3").toLocalIterator())
                return "application/sparql-results+json", json_lines(Compiler(s.spark, s.data, functions=s.functions, hooks=s.hooks), args["query"], v.prefixes | s.prefixes)
            case "GET", ["fragment"]:
                text = args["query"] if "query" in args else f"SELECT * WHERE {args['agp']}"
                style = args.get("format", "quad")
                return ("text/n3" if style == "n3" else "text/plain"), (r[0] + "\n" for r in quad_text(s.fragment_quads(text), style, v.prefixes | s.prefixes).toLocalIterator())
            case "GET", ["resources"] if self.resources:
                return [r[0] for r in self.resources.table().select("gid").orderBy("gid").collect()]
            case "GET", ["resources", gid] if self.resources:
                found = self.resources.table().filter(F.col("gid") == gid).select("data").first()
                if found is None:
                    raise NotFound(gid)
                return "text/turtle", found[0]
            case ("GET" | "POST"), ["plan"]:
                return "text/turtle", s.planner.plan(parse_agp(args.get("agp") or body, v.prefixes | s.prefixes)).turtle()
            case "GET", ["vocabs"]:
                return v.list()
            case "GET", ["vocabs", vid]:
                return "text/turtle", v.get(vid)
            case "POST", ["vocabs"]:
                with self.lock:
                    return {"id": v.add(body)}
            case "PUT", ["vocabs", vid]:
                with self.lock:
                    v.update(vid, body)
                return {"id": vid}
            case "DELETE", ["vocabs", vid]:
                with self.lock:
                    v.delete(vid)
                return {}
            case "GET", ["prefixes"]:
                return v.prefixes
            case "POST", ["prefixes"]:
                with self.lock:
                    v.add_prefixes(json.loads(body))
                return v.prefixes
            case "GET", ["types"]:
                return sorted(v.facts.types())
            case "GET", ["types", name]:
                return v.facts.type(self._name(name))
            case "GET", ["properties"]:
                return sorted(v.facts.properties())
            case "GET", ["properties", name]:
                return v.facts.property(self._name(name))
            case "GET", ["seeds"]:
                return [{"type": t, "uri": u, "id": k} for t, u, k in v.seeds.all()]
            case "POST", ["seeds"]:
                given = json.loads(body)
                with self.lock:
                    return {"id": v.seeds.add(given["uri"], self._name(given["type"]))}
            case "GET", ["seeds", "id", key]:
                t, u = v.seeds.get(key)
                return {"type": t, "uri": u, "id": key}
            case "DELETE", ["seeds", "id", key]:
                with self.lock:
                    v.seeds.delete(key)
                return {}
            case "GET", ["seeds", name, "digest"]:
                return {"digest": v.seeds.digest(self._name(name))}
            case "GET", ["seeds", name]:
                return v.seeds.of_type(self._name(name))
            case "DELETE", ["seeds", name]:
                with self.lock:
                    v.seeds.delete_type(self._name(name))
                return {}
            case "GET", ["paths", name]:
                nav = Navigator(v)
                paths = [{"cycles": list(p.cycles), "seeds": list(p.seeds), "steps": [{"type": t, "property": q} for t, q in p.steps]} for p in nav.paths(self._name(name))]
                used = {c for p in paths for c in p["cycles"]}
                return {"paths": paths, "all-cycles": [{"cycle": i, "steps": [{"property": q, "type": t} for t, q in c]} for i, c in enumerate(nav.cycles()) if i in used]}
        raise NotFound(f"no such resource: {method} /{'/'.join(parts)}")


class Client:
    """The same calls from another process."""

    def __init__(self, url: str, timeout: float = 600):
        self.url, self.timeout = url.rstrip("/"), timeout

    def _call(self, method: str, path: str, body: str | None = None, **args: str):
        target = f"{self.url}/{path}" + (f"?{urllib.parse.urlencode(args)}" if args else "")
        request = urllib.request.Request(target, body.encode() if body is not None else None, method=method)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                text = r.read().decode()
                return json.loads(text) if "json" in r.headers["Content-Type"] else text
        except urllib.error.HTTPError as e:
            said = json.loads(e.read() or b"{}").get("error", str(e))
            raise {404: NotFound, 409: Duplicate}.get(e.code, VocabularyError)(said) from e

    @staticmethod
    def _part(name: str) -> str:
        return urllib.parse.quote(name, safe="")

    def query(self, text: str) -> list[dict]:
        found = self._call("GET", "sparql", query=text)
        return found["results"]["bindings"] if "results" in found else found

    def ask(self, text: str) -> bool:
        return self._call("GET", "sparql", query=text)["boolean"]

    def fragment(self, text: str, style: str = "quad") -> list[str]:
        return self._call("GET", "fragment", query=text, format=style).splitlines()

    def search_plan(self, agp: str) -> str:
        return self._call("GET", "plan", agp=agp)

    def get(self, path: str):
        return self._call("GET", path)

    def add_vocabulary(self, text: str) -> str:
        return self._call("POST", "vocabs", text)["id"]

    def update_vocabulary(self, vid: str, text: str) -> None:
        self._call("PUT", f"vocabs/{self._part(vid)}", text)

    def delete_vocabulary(self, vid: str) -> None:
        self._call("DELETE", f"vocabs/{self._part(vid)}")

    def add_prefixes(self, prefixes: dict[str, str]) -> dict[str, str]:
        return self._call("POST", "prefixes", json.dumps(prefixes))

    def type(self, name: str) -> dict:
        return self._call("GET", f"types/{self._part(name)}")

    def property(self, name: str) -> dict:
        return self._call("GET", f"properties/{self._part(name)}")

    def add_seed(self, uri: str, type_: str) -> str:
        return self._call("POST", "seeds", json.dumps({"uri": uri, "type": type_}))["id"]

    def get_seed(self, key: str) -> dict:
        return self._call("GET", f"seeds/id/{self._part(key)}")

    def delete_seed(self, key: str) -> None:
        self._call("DELETE", f"seeds/id/{self._part(key)}")

    def seeds_of(self, type_: str) -> list[str]:
        return self._call("GET", f"seeds/{self._part(type_)}")

    def digest(self, type_: str) -> str:
        return self._call("GET", f"seeds/{self._part(type_)}/digest")["digest"]

    def paths(self, type_: str) -> dict:
        return self._call("GET", f"paths/{self._part(type_)}")
