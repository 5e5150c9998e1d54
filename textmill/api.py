"""A small HTTP service over an index, by the standard library's server."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import SparkSession

from .functions.embed import embedder_of, local_embedder
from .operators import index, lookup, search


class BadRequest(ValueError):
    """Parameters out of bounds."""


def _number(given: dict[str, str], name: str, default: int, most: int) -> int:
    try:
        value = int(given.get(name, default))
    except ValueError:
        value = 0
    if not 1 <= value <= most:
        raise BadRequest(f"{name} has to be a number from 1 to {most}")
    return value


def respond(opened: index.Index, path: str, api_key: str | None = None) -> tuple[int, dict | list]:
    """Status and body for a request path. ``mode=term`` looks the whole query
    up as one term; ``bm25``, ``vector`` and ``hybrid`` rank."""
    parts = urlsplit(path)
    given = {k: v[0] for k, v in parse_qs(parts.query).items()}
    try:
        if parts.path == "/health":
            return 200, {"status": "ok", "documents": opened.documents.count()}
        if parts.path == "/stats":
            return 200, lookup.stats(opened)
        if parts.path == "/documents":
            return 200, [r.asDict() for r in lookup.list_documents(opened, _number(given, "limit", 100, 500)).collect()]
        if parts.path.startswith("/documents/"):
            found = lookup.get_document(opened, unquote(parts.path.removeprefix("/documents/")))
            return (200, found) if found else (404, {"detail": "no such document"})
        if parts.path == "/search":
            limit, mode = _number(given, "limit", 20, 100), given.get("mode", "term")
            if not given.get("q"):
                raise BadRequest("q has to be one character at least")
            if mode not in ("term", "bm25", "vector", "hybrid"):
                raise BadRequest("mode has to be term, bm25, vector or hybrid")
            asked = search.queries_of(opened, [given["q"]])
            if mode == "term":
                hits = search.exact_term(opened, asked, limit)
            else:
                meta = opened.read_meta()
                embedder = embedder_of(meta, api_key) if "embedder" in meta else local_embedder()
                hits = search.run(opened, asked, "term" if mode == "bm25" else mode, embedder, limit)
            return 200, {"query": given["q"], "mode": mode, "hits": [r.asDict() for r in hits.orderBy("rank").collect()]}
    except BadRequest as error:
        return 422, {"detail": str(error)}
    return 404, {"detail": "no such path"}


def server(spark: SparkSession, path: str, host: str, port: int) -> ThreadingHTTPServer:
    opened = index.load(spark, path)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = respond(opened, self.path)
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(spark: SparkSession, path: str, host: str = "127.0.0.1", port: int = 8000) -> None:
    server(spark, path, host, port).serve_forever()
