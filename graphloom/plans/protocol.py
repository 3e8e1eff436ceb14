"""The query protocol: requests as dicts or JSON lines, answered from a code graph; and the HTTP wrapper of it."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.operators import traversal as T
from graphloom.plans.codegraph import RUNTIME, CodeGraph

VERSION = 1


@dataclass(frozen=True)
class Field:
    """What a request's field may hold; error texts are part of the protocol."""

    kind: type
    default: object = None
    required: bool = False
    least: int | None = None
    allowed: tuple[str, ...] = ()

    def fault(self, value: object) -> str | None:
        if value is None and self.kind is str:
            return "is required" if self.required else None
        if type(value) is not self.kind:
            return {str: "must be a string", int: "must be an integer", bool: "must be a boolean"}[self.kind]
        if self.allowed and value not in self.allowed:
            return f"must be one of: {', '.join(sorted(self.allowed))}"
        return f"must be >= {self.least}" if self.least is not None and value < self.least else None


_target, _most = Field(str, required=True), Field(int, 200, least=1)
_filters = {k: Field(bool, False) for k in ("resolved_only", "local_only", "hide_runtime", "dedupe")}
#: The fields that each operation reads.
FIELDS: dict[str, dict[str, Field]] = {
    "symbols": {"query": Field(str), "kind": Field(str, "all", allowed=("all", "function", "class", "symbol")), "max_results": _most},
    "inspect": {"file": _target, "level": Field(str, "functions", allowed=("summary", "functions", "calls", "full")), "max_functions": _most, "max_calls": Field(int, 20, least=0)},
    "callgraph": {"raw": Field(bool, False), "direction": Field(str, "outbound", allowed=("outbound", "inbound")), "depth": Field(int, 2, least=0), "target": _target, "max_results": _most},
    "using": _filters | {"depth": Field(int, 1, least=0), "target": _target, "max_results": _most},
}
FIELDS["usages"] = FIELDS["using"]


def read(request: dict, fields: dict[str, Field]) -> dict:
    """The fields' values, defaults filled in; the first that may not be so is an error."""
    values = {}
    for name, field in fields.items():
        values[name] = request.get(name, field.default)
        fault = field.fault(values[name])
        if fault:
            raise ValueError(f"{name} {fault}")
    return values


def call_edges(g: CodeGraph) -> DataFrame:
    """(src, dst, call, location) of all calls; dst null where the callee is unknown. src null calls are left out."""
    f = g.files.select(F.col("id").alias("_f"), "path")
    c = g.calls.where("source_symbol_id is not null").join(f, F.col("source_file_id") == F.col("_f"))
    return c.select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"), F.concat_ws(".", "qualifier", "name").alias("call"), S.location(F.col("path"), F.col("range.start_row")).alias("location"), F.col("range.start_byte").alias("at"))


def trace(g: CodeGraph, target: str, direction: str, depth: int, max_results: int, resolved_only: bool = False, local_only: bool = False, hide_runtime: bool = False, dedupe: bool = False) -> list[dict]:
    """Edges of a trace from the target, in the order of (depth, location), filtered, at most max_results.

    Inbound, other references stand in where nothing calls the target.
    """
    start = g.resolve_target(target).select(F.col("id").alias("node"))
    if not start.limit(1).count():
        raise KeyError(f"no symbol matches {target!r}")
    inbound = direction == "inbound"
    edges = call_edges(g)
    known = edges.where("dst is not null")
    if inbound and not known.join(start, F.col("dst") == F.col("node"), "left_semi").limit(1).count():
        f = g.files.select(F.col("id").alias("_f"), "path")
        r = g.references.where("source_symbol_id is not null").join(f, F.col("source_file_id") == F.col("_f"))
        edges = r.select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"), F.col("name").alias("call"), S.location(F.col("path"), F.col("range.start_row")).alias("location"), F.col("range.start_byte").alias("at"))
        known = edges
    hops = T.trace(known.select("src", "dst"), start, depth, inbound=inbound)
    near, far = ("dst", "src") if inbound else ("src", "dst")
    seen = hops.groupBy(F.col(near).alias("_n")).agg(F.min("depth").alias("depth"))
    if not inbound:  # a node on the last hop's near side may have unresolved calls only
        level = start.select(F.col("node").alias("_n"), F.lit(1).alias("depth")).unionAll(hops.where(F.col("depth") < depth).select(F.col(far).alias("_n"), (F.col("depth") + 1).alias("depth")))
        seen = level.groupBy("_n").agg(F.min("depth").alias("depth"))
    out = edges.join(seen, F.col(near) == F.col("_n")).drop("_n") if depth else edges.where(F.lit(False)).withColumn("depth", F.lit(0))
    if resolved_only or local_only:
        out = out.where("dst is not null")
    if hide_runtime:
        out = out.where(F.col("dst").isNotNull() | ~F.col("call").isin(*RUNTIME))
    if dedupe:
        out = out.groupBy("depth", "src", "dst", "call").agg(F.min_by("location", "at").alias("location"), F.min("at").alias("at"))
    n = g.symbols.select(F.col("id").alias("_i"), "name")
    out = out.join(n.select(F.col("_i").alias("src"), F.col("name").alias("source")), "src").join(n.select(F.col("_i").alias("dst"), F.col("name").alias("target")), "dst", "left")
    rows = out.select("source", "target", "call", "location", "depth", "at").distinct().orderBy("depth", "location", "at", "call").limit(max_results).collect()
    return [{k: r[k] for k in ("source", "target", "call", "location", "depth")} for r in rows]


def inspect(g: CodeGraph, ref: str, level: str, max_functions: int, max_calls: int) -> dict:
    """Counts of a file, its functions, and their calls."""
    path = g.find_file(ref)
    row = g.get_file(path).first()
    in_file = lambda d, c="file_id": d.where(F.col(c) == row.id)
    out = {"file": path, "module": row.module_name, "lines": row.line_count, "has_error": row.has_error, "symbols": in_file(g.symbols).count(), "imports": in_file(g.imports).count(), "classes": in_file(g.symbols.where("kind = 'class'")).count(), "functions_count": in_file(g.symbols.where("kind = 'function'")).count()}
    if level == "summary":
        return out
    f = in_file(g.symbols.where("kind = 'function'")).select("id", "name", "range.start_row").orderBy("start_row", "id").limit(max_functions)
    if level == "functions":
        return out | {"functions": [{"name": r["name"], "line": r.start_row + 1} for r in f.collect()]}
    c = in_file(g.calls, "source_file_id").select(F.col("source_symbol_id").alias("id"), F.struct(F.col("range.start_byte").alias("at"), F.concat_ws(".", "qualifier", "name").alias("call")).alias("c"))
    c = c.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("c")), F.lit(1), F.lit(max(1, max_calls))).alias("calls"), F.count("*").alias("n"))
    rows = f.join(c, "id", "left").orderBy("start_row", "id").collect()
    out["functions"] = [{"name": r["name"], "line": r.start_row + 1, "calls_count": r.n or 0, "calls": [x["call"] for x in (r.calls or [])][:max_calls]} for r in rows]
    if level == "full":
        out["import_rows"] = [r.asDict() for r in in_file(g.imports).select("kind", "module", "name", "alias").orderBy("id").collect()]
    return out


class Session:
    """Answers requests {"op": ..., "id": ...}; build makes the graph, stamp tells whether the sources have changed."""

    def __init__(self, build: Callable[[], CodeGraph], stamp: Callable[[], str] | None = None):
        self.build, self.stamp = build, stamp or (lambda: "")
        self.reload()

    def reload(self) -> dict:
        began = time.perf_counter()
        self.seen, self.graph = self.stamp(), self.build()
        return {"reloaded": True, "elapsed_seconds": round(time.perf_counter() - began, 3)}

    def status(self) -> dict:
        return {"stale": self.stamp() != self.seen, "language": self.graph.language}

    def answer(self, request: dict) -> dict:
        head = {"schema_version": VERSION, "id": request.get("id") if isinstance(request, dict) else None, "op": request.get("op") if isinstance(request, dict) else None}
        try:
            if not isinstance(request, dict):
                raise ValueError("a request is an object")
            if read(request, {"reload_if_stale": Field(bool, False)})["reload_if_stale"] and head["op"] not in ("status", "reload") and self.status()["stale"]:
                self.reload()
            return head | {"ok": True, "result": self.dispatch(request)}
        except Exception as e:  # a bad request must not end the session
            return head | {"ok": False, "error": {"type": type(e).__name__, "message": str(e)}}

    def dispatch(self, r: dict) -> dict:
        g, op = self.graph, read(r, {"op": Field(str, required=True)})["op"]
        if op in ("summary", "parse"):
            return g.summary()
        if op == "status":
            return self.status()
        if op == "reload":
            return self.reload()
        if op not in FIELDS:
            raise ValueError(f"unsupported op {op!r}")
        x = read(r, FIELDS[op])
        if op == "symbols":
            rows = g.search_symbols(x["query"], "all" if x["kind"] == "symbol" else x["kind"], x["max_results"]).collect()
            return x | {"symbols": [row.asDict() for row in rows]}
        if op == "inspect":
            return inspect(g, x["file"], x["level"], x["max_functions"], x["max_calls"])
        if op == "callgraph":
            filters = {} if x["raw"] else dict.fromkeys(_filters, True)
            return self._trace(x, x["direction"], filters) | {"raw": x["raw"]}
        filters = {k: x[k] for k in _filters}
        return self._trace(x, "outbound" if op == "using" else "inbound", filters) | {"filters": filters}

    def _trace(self, x: dict, direction: str, filters: dict) -> dict:
        edges = trace(self.graph, x["target"], direction, x["depth"], x["max_results"], **filters)
        return {"target": x["target"], "direction": direction, "depth": x["depth"], "max_results": x["max_results"], "edges": edges}

    def lines(self, lines: Iterable[str]) -> Iterator[str]:
        """One answer a line until exit or quit; blank lines are skipped, broken ones answered with an error."""
        for i, line in enumerate(lines, 1):
            if not line.strip():
                continue
            try:
                request = json.loads(line)
            except ValueError as e:
                yield json.dumps({"schema_version": VERSION, "id": None, "op": None, "ok": False, "line": i, "error": {"type": "ValueError", "message": str(e)}}, sort_keys=True)
                continue
            if isinstance(request, dict) and request.get("op") in ("exit", "quit"):
                yield json.dumps({"schema_version": VERSION, "id": request.get("id"), "op": request["op"], "ok": True, "result": {"bye": True}}, sort_keys=True)
                return
            yield json.dumps(self.answer(request), sort_keys=True, default=str)


def serve(session: Session, host: str = "127.0.0.1", port: int = 0) -> HTTPServer:
    """An HTTP server that answers POSTed requests; the caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                out = session.answer(json.loads(body))
            except ValueError as e:
                out = {"schema_version": VERSION, "ok": False, "error": {"type": "ValueError", "message": str(e)}}
            data = json.dumps(out, sort_keys=True, default=str).encode()
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return HTTPServer((host, port), Handler)
