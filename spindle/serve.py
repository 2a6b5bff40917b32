"""Servers over one workspace: JSON-RPC lines on standard input, and HTTP on the loopback address."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer

from .api import Workspace
from .errors import Refused
from .operators import graph
from .plans import mesh as meshes
from .sinks import nodelink

SHOWN = 200


def _rows(df) -> list[dict] | None:
    return None if df is None else [r.asDict(recursive=True) for r in df.limit(SHOWN).collect()]


def tools(w: Workspace) -> dict[str, tuple[list[str], Callable]]:
    """Name -> (required arguments, function)."""

    def search(text: str, limit: int = 10) -> dict:
        r = w.mesh_search(text, limit)
        return {"status": r.status, "hits": _rows(r.rows), "warnings": r.warnings, "moved": r.moved}

    def neighbors(key: str, depth: int = 1) -> dict:
        rows = w.neighbours(key, depth)
        if rows is None:
            return {"status": "absent", "edges": None, "warnings": [f"no node {key!r}"]}
        uncertain = not rows.where("confidence < 1").limit(1).isEmpty()
        return {"status": "partial" if uncertain else "complete", "edges": _rows(rows), "warnings": ["some edges are derived"] if uncertain else []}

    def query(model: str, text: str) -> dict:
        a = w.query(model, text)
        return {"status": a.status, "columns": a.columns, "rows": _rows(a.rows), "warnings": a.warnings, "candidates": a.candidates}

    def path(a: str, b: str, depth: int = 4) -> dict:
        found = w.path_between(a, b, depth)
        return {"status": "complete", "path": found}

    def explain(text: str, limit: int = 10) -> dict:
        return {m: _rows(r) for m, r in meshes.explain(w.stores(), text, limit).items()}

    return {"mesh_search": (["text"], search), "mesh_neighbors": (["key"], neighbors), "query": (["model", "text"], query), "mesh_path": (["a", "b"], path), "mesh_explain": (["text"], explain)}


def handle(line: str, known: dict[str, tuple[list[str], Callable]]) -> dict | None:
    """The answer to one JSON-RPC line; None to a notification."""

    def error(code: int, message: str, at=None) -> dict:
        return {"jsonrpc": "2.0", "id": at, "error": {"code": code, "message": message}}

    try:
        request = json.loads(line)
    except ValueError:
        return error(-32700, "no JSON")
    if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
        return error(-32600, "no request")
    at, method, params = request.get("id"), request["method"], request.get("params") or {}
    if "id" not in request:
        return None
    if method == "initialize":
        result = {"protocolVersion": "2024-11-05", "serverInfo": {"name": "spindle", "version": "1"}, "capabilities": {"tools": {}}}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "inputSchema": {"type": "object", "required": need}} for n, (need, _) in known.items()]}
    elif method == "tools/call":
        name, args = params.get("name"), params.get("arguments") or {}
        if name not in known:
            return error(-32602, f"no tool {name!r}", at)
        need, f = known[name]
        if lacking := [k for k in need if k not in args]:
            return error(-32602, f"{name} needs {', '.join(lacking)}", at)
        try:
            result = {"content": [{"type": "text", "text": json.dumps(f(**args), ensure_ascii=False, default=str)}], "isError": False}
        except TypeError as e:
            return error(-32602, str(e), at)
        except Refused as e:
            result = {"content": [{"type": "text", "text": f"refused: {e}"}], "isError": True}
    else:
        return error(-32601, f"no method {method!r}", at)
    return {"jsonrpc": "2.0", "id": at, "result": result}


def stdio(w: Workspace) -> None:
    known = tools(w)
    for line in sys.stdin:
        if line.strip() and (answer := handle(line, known)) is not None:
            print(json.dumps(answer, ensure_ascii=False), flush=True)


def http(w: Workspace, port: int) -> None:
    known = tools(w)
    calls = {"/search": "mesh_search", "/query": "query", "/neighbors": "mesh_neighbors", "/path": "mesh_path"}

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: str, kind: str = "application/json") -> None:
            raw = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            if self.path not in ("/", "/graph"):
                return self._send(404, "{}")
            m = w.mesh()
            data = nodelink.payload(m.nodes, m.edges)
            return self._send(200, json.dumps(data)) if self.path == "/graph" else self._send(200, nodelink.render(data), "text/html")

        def do_POST(self) -> None:
            try:
                args = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                if self.path == "/bridges":
                    m = w.mesh()
                    return self._send(200, json.dumps(graph.bridges(m.nodes, m.edges, args["src"], args["dsts"])))
                return self._send(200, json.dumps(known[calls[self.path]][1](**args), ensure_ascii=False, default=str))
            except KeyError:
                return self._send(404, "{}")
            except (Refused, TypeError, ValueError) as e:
                return self._send(400, json.dumps({"refused": str(e)}))

        def log_message(self, *_args) -> None: ...

    HTTPServer(("127.0.0.1", port), Handler).serve_forever()
