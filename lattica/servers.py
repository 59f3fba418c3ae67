"""A published graph served: JSON over HTTP, and tools over standard input and output (JSON-RPC).

Both hand requests to ``Service``, whose answers are small queries over the graph's
two tables; every list has a limit.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO, Any
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import analytics, filters, search
from lattica.plans import context
from lattica.schema import Graph

NAME, VERSION, PROTOCOL = "lattica", "0.2.0", "2024-11-05"


class Missing(LookupError):
    """What was asked for is not there."""


class Service:
    def __init__(self, graph: Graph, head: dict | None = None):
        self.graph = Graph(graph.nodes.cache(), graph.edges.cache())
        self.head = head or {}
        counts = {"nodes": self.graph.nodes.count(), "edges": self.graph.edges.count()}
        mark = self.graph.nodes.select(F.xxhash64("id", "label", "type").alias("h")).union(self.graph.edges.select(F.xxhash64("src", "rel", "dst")))
        self.counts, self.etag = counts, f'"{(mark.agg(F.bit_xor("h")).first()[0] or 0) & (1 << 64) - 1:016x}"'

    @staticmethod
    def rows(df: DataFrame) -> list[dict]:
        """Rows of a limited result as JSON objects without empty values."""
        return [json.loads(r["x"]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("x")).collect()]

    def root(self) -> dict:
        return {"status": "ok", "service": NAME, "version": VERSION, "counts": self.counts, "metadata": self.head}

    def stats(self) -> dict:
        types = {r["type"] or "Unknown": r["n"] for r in analytics.counts(self.graph.nodes, "type").collect()}
        return {**self.counts, "entity_types": self.head.get("entity_types", []), "types": types}

    def nodes(self, query: str = "", type: str | None = None, limit: int = 100, offset: int = 0) -> list[dict]:
        return self.rows(filters.search_nodes(self.graph.nodes, query, type, limit, offset).drop("ord"))

    def node(self, id: str) -> dict:
        found = self.rows(self.graph.nodes.where(F.col("id") == id).limit(1).drop("ord"))
        if not found:
            raise Missing(f"Node not found: {id}")
        e = self.graph.edges.drop("ord")
        return {"node": found[0], "outbound": self.rows(e.where(F.col("src") == id)), "inbound": self.rows(e.where(F.col("dst") == id))}

    def edges(self, src: str | None = None, dst: str | None = None, rel: str | None = None, limit: int = 200, offset: int = 0) -> list[dict]:
        return self.rows(filters.filter_edges(self.graph.edges, src, dst, rel, limit, offset).drop("ord"))

    def context(self, entity: str, algorithm: str = "ppr", top_k: int = 15, depth: int = 1) -> dict:
        if algorithm == "hybrid":
            best, edges = search.hybrid(self.graph, entity, top_k)
            nodes = self.graph.nodes.join(best, "id").orderBy(F.desc("score"), "id").drop("ord")
            return {"query": entity, "nodes": self.rows(nodes), "edges": self.rows(edges.drop("ord"))}
        found = context.ego(self.graph, entity, algorithm, top_k, depth)
        if found is None:
            raise Missing(f"Entity not found: {entity}")
        documents = [r["doc"] for r in context.evidence(found.edges).collect()]
        return {"query": entity, "nodes": self.rows(found.nodes.orderBy("ord", "id").drop("ord")), "edges": self.rows(found.edges.orderBy("ord").drop("ord")), "evidence": documents}

    def audit(self) -> dict:
        return self.rows(analytics.audit(self.graph))[0]

    def provenance(self, src: str, dst: str) -> list[dict]:
        return self.rows(self.graph.edges.where((F.col("src") == src) & (F.col("dst") == dst)).drop("ord"))


def as_markdown(found: dict) -> str:
    """The context of an entity as text: entities, relations, documents."""
    names = {n["id"]: n.get("label", n["id"]) for n in found["nodes"]}
    lines = [f"# Context: {found['query']}", "", "## Entities"]
    lines += [f"- **{n.get('label', n['id'])}** ({n.get('type', 'Unknown')}, `{n['id']}`)" for n in found["nodes"]]
    lines += ["", "## Relations", *(f"- {names.get(e['src'], e['src'])} --[{e['rel']}]--> {names.get(e['dst'], e['dst'])}" for e in found["edges"])]
    if found.get("evidence"):
        lines += ["", "## Evidence", *(f"- {d}" for d in found["evidence"])]
    return "\n".join(lines) + "\n"


def respond(service: Service, path: str, ask: dict[str, str]) -> tuple[int, Any]:
    """(status, JSON value or text) of a GET request."""
    take = lambda *names: {n: ask[n] for n in names if n in ask}
    number = lambda *names: {n: int(ask[n]) for n in names if n in ask}
    path = path.rstrip("/")
    try:
        if path == "":
            return 200, service.root()
        if path == "/stats":
            return 200, service.stats()
        if path == "/nodes":
            return 200, service.nodes(**take("query", "type"), **number("limit", "offset"))
        if path.startswith("/nodes/"):
            return 200, service.node(unquote(path.removeprefix("/nodes/")))
        if path == "/edges":
            return 200, service.edges(**take("src", "dst", "rel"), **number("limit", "offset"))
        if path == "/context":
            if not ask.get("entity"):
                return 400, {"error": "Missing required query parameter 'entity'"}
            found = service.context(ask["entity"], **take("algorithm"), **number("top_k", "depth"))
            return 200, as_markdown(found) if ask.get("format") == "markdown" else found
        if path == "/audit":
            return 200, service.audit()
    except Missing as e:
        return 404, {"error": str(e)}
    except ValueError as e:
        return 400, {"error": str(e)}
    return 404, {"error": f"Endpoint not found: {path}"}


def http_server(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_) -> None:
            pass

        def _send(self, status: int, body: bytes = b"", kind: str = "", etag: bool = False) -> None:
            self.send_response(status)
            for k, v in (("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, OPTIONS"), ("Access-Control-Allow-Headers", "*")):
                self.send_header(k, v)
            if etag:
                self.send_header("ETag", service.etag)
            if kind:
                self.send_header("Content-Type", f"{kind}; charset=utf-8")
                self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_OPTIONS(self) -> None:
            self._send(204)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            root = url.path.rstrip("/") == ""
            if root and self.headers.get("If-None-Match") == service.etag:
                return self._send(304, etag=True)
            status, value = respond(service, url.path, {k: v[0] for k, v in parse_qs(url.query).items()})
            if isinstance(value, str):
                return self._send(status, value.encode(), "text/markdown")
            self._send(status, json.dumps(value, indent=2, ensure_ascii=False).encode(), "application/json", root)

    return ThreadingHTTPServer((host, port), Handler)


def _schema(required: tuple[str, ...], **properties: tuple[str, str]) -> dict:
    return {"type": "object", "properties": {k: {"type": t, "description": d} for k, (t, d) in properties.items()}, "required": list(required)}


class Tools:
    """The service as tools of a model: one JSON-RPC message in, one or none out."""

    def __init__(self, service: Service):
        text = lambda found: json.dumps(found, indent=2, ensure_ascii=False)
        around = lambda **options: as_markdown(service.context(**options))
        self.calls: dict[str, tuple[str, dict, Callable[..., str]]] = {
            "search_nodes": ("Find nodes by id, label or alias.", _schema(("query",), query=("string", "What to look for"), type_filter=("string", "Only nodes of this type"), limit=("integer", "Most results (10)")), lambda query, type_filter=None, limit=10: text(service.nodes(str(query), type_filter, int(limit)))),
            "extract_context_ppr": ("The surroundings of an entity by personalised PageRank.", _schema(("entity",), entity=("string", "Id or label"), top_k=("integer", "Most nodes (15)")), lambda entity, top_k=15: around(entity=entity, top_k=int(top_k))),
            "traverse_subgraph": ("The rings around an entity.", _schema(("entity",), entity=("string", "Id or label"), depth=("integer", "1 or 2 rings")), lambda entity, depth=1: around(entity=entity, algorithm="bfs", depth=int(depth))),
            "audit_graph": ("Measures of the graph's shape and faults.", _schema(()), lambda: text(service.audit())),
            "get_provenance": ("Edges from one node to another with their documents and explanations.", _schema(("src", "dst"), src=("string", "Source id"), dst=("string", "Target id")), lambda src, dst: text(found) if (found := service.provenance(src, dst)) else f"No direct edges found from '{src}' to '{dst}'."),
        }

    def _result(self, method: str, params: dict) -> dict | None:
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": NAME, "version": VERSION}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s, _) in self.calls.items()]}
        if method == "tools/call":
            name = params.get("name", "")
            try:
                if name not in self.calls:
                    raise ValueError(f"Unknown tool '{name}'")
                said, failed = self.calls[name][2](**params.get("arguments", {})), False
            except Missing as e:
                said, failed = str(e), False
            except Exception as e:  # a tool's failure is an answer, not the end of the server
                said, failed = f"Error: {e}", True
            return {"content": [{"type": "text", "text": said}], "isError": failed}
        return None

    def handle(self, message: dict) -> dict | None:
        """The answer to a message; none to a notification."""
        head = {"jsonrpc": "2.0", "id": message.get("id")}
        found = self._result(message.get("method", ""), message.get("params") or {})
        if message.get("id") is None:
            return None
        return head | ({"result": found} if found is not None else {"error": {"code": -32601, "message": f"Method not found: {message.get('method')}"}})

    def serve(self, source: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
        """Answers lines until the input ends."""
        for line in filter(str.strip, source):
            try:
                answer = self.handle(json.loads(line))
            except ValueError as e:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"Parse error: {e}"}}
            if answer is not None:
                out.write(json.dumps(answer, ensure_ascii=False) + "\n")
                out.flush()
