"""A tool server on standard input and output (JSON-RPC, a message a line):
seven tools, each a command of the command line.

    python -m textmill.mcp
"""

from __future__ import annotations

import contextlib
import io
import json
import sys
from collections.abc import Callable
from typing import TextIO

from .cli import VERSION, main

_S, _I, _B = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}

#: name: what it does, properties, required ones, arguments of the command line.
TOOLS: dict[str, tuple[str, dict, list[str], Callable[[dict], list[str]]]] = {
    "ingest": ("Hash, classify and de-duplicate a folder", {"corpus": _S, "out": _S, "quarantine_dir": _S}, ["corpus"], lambda v: ["ingest", v["corpus"]]),
    "parse": ("Cut the documents of a manifest into chunks", {"manifest": _S, "corpus": _S, "out": _S}, [], lambda v: ["parse"]),
    "index": ("Build an index of a manifest and its chunks", {"manifest": _S, "chunks": _S, "out": _S, "embedder": _S, "embedding_base_url": _S, "embedding_model": _S}, [], lambda v: ["index"]),
    "verify": ("Trace every row of an index to its source", {"corpus": _S, "index": _S, "manifest": _S, "exemptions": _S}, ["corpus"], lambda v: ["verify", v["corpus"]]),
    "search": ("Ranked search", {"query": _S, "index": _S, "mode": _S, "limit": _I}, ["query"], lambda v: ["query", "search", v["query"]]),
    "answer": ("Answer with cited sentences, or refuse", {"query": _S, "index": _S, "mode": _S, "k": _I}, ["query"], lambda v: ["answer", v["query"]]),
    "eval": ("Metrics over labelled queries", {"index": _S, "queries": _S, "mode": _S, "k": _I, "check": _B, "baseline": _S}, [], lambda v: ["eval"]),
}


def call(name: str, values: dict, run: Callable[[list[str]], int] = main) -> dict:
    _, properties, required, start = TOOLS[name]
    if missing := [r for r in required if not values.get(r)]:
        return {"content": [{"type": "text", "text": f"missing: {', '.join(missing)}"}], "isError": True}
    argv = start(values)
    for key in properties:
        value = values.get(key)
        if key in required or value is None or value is False:
            continue
        argv += [f"--{key.replace('_', '-')}"] + ([] if value is True else [str(value)])
    out = io.StringIO()
    try:
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(out):
            code = run(argv)
    except SystemExit as stop:
        code = int(stop.code or 0)
    return {"content": [{"type": "text", "text": out.getvalue()}], "isError": code != 0}


def handle(message: dict, run: Callable[[list[str]], int] = main) -> dict | None:
    """The answer to a message; none to a notification."""
    if "id" not in message:
        return None
    method, params = message.get("method"), message.get("params") or {}
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "textmill", "version": VERSION}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r, _) in TOOLS.items()]}}
    if method in ("resources/list", "prompts/list"):
        return reply | {"result": {method.split("/")[0]: []}}
    if method == "tools/call" and params.get("name") in TOOLS:
        return reply | {"result": call(params["name"], params.get("arguments") or {}, run)}
    if method == "tools/call":
        return reply | {"error": {"code": -32602, "message": f"unknown tool {params.get('name')!r}"}}
    return reply | {"error": {"code": -32601, "message": f"unknown method {method!r}"}}


def serve(stdin: TextIO = sys.stdin, stdout: TextIO = sys.stdout) -> int:
    for line in stdin:
        if not line.strip():
            continue
        try:
            reply = handle(json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            print(json.dumps(reply), file=stdout, flush=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(serve())
