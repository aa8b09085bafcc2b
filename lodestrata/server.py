"""The api over standard input and output: JSON-RPC lines with tools that a client can list and call."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from lodestrata import __version__, api

_TEXT, _NUMBER, _FLAG = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
#: Tool to (what it does, its arguments, those it needs).
TOOLS = {
    "search": ("Search by meaning, words, pattern or structure", {"query": _TEXT, "top_k": _NUMBER, "budget": _NUMBER, "token": _TEXT, "mode": _TEXT}, ["query"]),
    "read": ("Read a file, a range or its skeleton", {"file": _TEXT, "span": _TEXT, "snap": _TEXT, "skeleton": _FLAG, "outlined": _FLAG, "budget": _NUMBER, "if_changed": _TEXT, "mode": _TEXT}, ["file"]),
    "find": ("List files", {"pattern": _TEXT, "depth": _NUMBER, "related_to": _TEXT, "budget": _NUMBER}, []),
    "exists": ("Whether all tokens of a pattern occur", {"pattern": _TEXT}, ["pattern"]),
    "outline": ("Symbols of a file or folder", {"path": _TEXT, "depth": _NUMBER, "kind": _TEXT}, []),
    "run": ("Run a command and read its output", {"command": {"type": "array", "items": _TEXT}, "raw": _FLAG, "full": _FLAG}, ["command"]),
}


def answer(space: api.Workspace, line: str) -> dict | None:
    """The response to one line; null for what needs none."""
    try:
        asked = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
    method, params, number = asked.get("method"), asked.get("params") or {}, asked.get("id")
    if number is None:
        return None
    if method == "initialize":
        result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestrata", "version": __version__}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}
    elif method == "tools/call":
        name, given = params.get("name"), params.get("arguments") or {}
        if name not in TOOLS or set(given) - set(TOOLS[name][1]) or set(TOOLS[name][2]) - set(given):
            return {"jsonrpc": "2.0", "id": number, "error": {"code": -32602, "message": f"no tool {name} with these arguments"}}
        body = api.run(space, name, **given)
        result = {"content": [{"type": "text", "text": body}], "isError": json.loads(body)["status"] == "error"}
    else:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"no method {method}"}}
    return {"jsonrpc": "2.0", "id": number, "result": result}


def serve(space: api.Workspace, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    for line in source:
        if line.strip() and (out := answer(space, line)) is not None:
            sink.write(json.dumps(out, ensure_ascii=False) + "\n")
            sink.flush()
