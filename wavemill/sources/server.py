"""A session's tools as JSON-RPC 2.0 over lines of text: one request a line, one
answer a line. Tools are listed by `tools/list` and called by `tools/call`; a tool's
failure is a result with `isError`, a malformed request an error."""

from __future__ import annotations

import json
from typing import IO

from ..functions.provenance import NUMERICS_VERSION
from ..plans.scattering import KEYS
from .session import Session

PROTOCOL = "2024-11-05"

_OID = {"type": "string", "pattern": "^[0-9a-f]{28}$"}
_CONFIG = {k: {} for k in KEYS}
_SEARCH = {"oid": _OID, "k": {"type": "integer"}, "directions": {"type": "integer"}, "seed": {"type": "integer"}}
TOOLS = {
    "compute_scattering": ("Scatter a stored tensor", {"input_oid": _OID, **_CONFIG}, ["input_oid", "J"]),
    "reduce": ("Reduce coefficients: ratio, log_mean, mean or std", {"oid": _OID, "method": {"type": "string"}}, ["oid"]),
    "compare": ("Nearest earlier results of the same configuration", _SEARCH, ["oid"]),
    "detect_anomaly": ("Flag events far from earlier results", {**_SEARCH, "tau": {"type": "number"}}, ["oid", "tau"]),
}
ALIASES = {"reduce_scattering": "reduce"}


class RequestError(ValueError):
    def __init__(self, code: int, text: str):
        super().__init__(text)
        self.code = code


def _call(session: Session, name: str, args: dict) -> dict:
    name = ALIASES.get(name, name)
    if name not in TOOLS:
        raise RequestError(-32602, f"no tool {name}")
    known, needed = TOOLS[name][1:]
    wrong, missing = sorted(set(args) - set(known)), [k for k in needed if k not in args]
    if wrong or missing:
        raise ValueError(f"unknown arguments {wrong}, missing {missing}")
    if name == "compute_scattering":
        return session.compute_scattering(args["input_oid"], {k: v for k, v in args.items() if k != "input_oid"})
    return getattr(session, name)(**args)


def handle(session: Session, request: dict) -> dict | None:
    """The answer to a request; None to a notification."""
    method, params = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    if method == "initialize":
        result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "wavemill", "version": str(NUMERICS_VERSION)}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}
    elif method == "tools/call":
        if not isinstance(params.get("name"), str) or not isinstance(params.get("arguments", {}), dict):
            raise RequestError(-32602, "a call has a name and arguments")
        try:
            got = _call(session, params["name"], params.get("arguments", {}))
            result = {"content": [{"type": "text", "text": json.dumps(got)}], "structuredContent": got, "isError": False}
        except RequestError:
            raise
        except (ValueError, KeyError, TypeError) as e:
            result = {"content": [{"type": "text", "text": str(e)}], "isError": True}
    else:
        raise RequestError(-32601, f"no method {method}")
    return {"jsonrpc": "2.0", "id": request["id"], "result": result}


def handle_line(session: Session, line: str) -> str | None:
    ident = None
    try:
        try:
            request = json.loads(line)
        except ValueError:
            raise RequestError(-32700, "not JSON") from None
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0":
            raise RequestError(-32600, "not a request")
        ident = request.get("id")
        answer = handle(session, request)
    except RequestError as e:
        answer = {"jsonrpc": "2.0", "id": ident, "error": {"code": e.code, "message": str(e)}}
    return None if answer is None else json.dumps(answer)


def serve(session: Session, lines: IO[str], out: IO[str]) -> None:
    """Until the lines end; the session's tensors stay."""
    for line in lines:
        if line.strip() and (answer := handle_line(session, line)) is not None:
            out.write(answer + "\n")
            out.flush()
