"""Command line: python -m graphloom COMMAND PATH ...; answers are JSON on standard output."""

from __future__ import annotations

import argparse
import json
import sys
import time


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("command", choices=["parse", "symbols", "inspect", "callgraph", "usages", "using", "query", "serve", "rename", "run", "diagnose", "list"])
    p.add_argument("path")
    p.add_argument("target", nargs="?", help="symbol, file or codemod")
    p.add_argument("--language")
    p.add_argument("--subdir", action="append", default=[])
    p.add_argument("--depth", type=int, default=1)
    p.add_argument("--direction", default="outbound")
    p.add_argument("--max-results", type=int, default=200)
    p.add_argument("--kind", default="all")
    p.add_argument("--level", default="functions")
    p.add_argument("--raw", action="store_true")
    p.add_argument("--new-name")
    p.add_argument("--write", action="store_true", help="write changed files; else print their diffs")
    p.add_argument("--port", type=int, default=8765)
    p.add_argument("--arguments", default="{}", help="JSON arguments of a codemod")
    p.add_argument("--module", action="append", default=[], help="Python files that register codemods")
    a = p.parse_args(argv)

    from graphloom.plans import codemods

    for m in a.module:
        codemods.load(m)
    if a.command == "list":
        print(json.dumps(codemods.listing(), indent=1))
        return 0

    from pyspark.sql import SparkSession

    from graphloom.operators import edits as E
    from graphloom.plans import protocol, refactor
    from graphloom.plans.codegraph import CodeGraph

    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    build = lambda: CodeGraph.from_path(spark, a.path, a.language, subdirs=tuple(a.subdir))
    began = time.perf_counter()
    session = protocol.Session(build)
    if a.command in ("rename", "run"):
        g = session.graph
        changes = refactor.rename(g, g.resolve_target(a.target), a.new_name) if a.command == "rename" else codemods.run(a.target, g, **json.loads(a.arguments))
        result = E.apply(g.sources, changes)
        if a.write:
            root = a.path if "://" in a.path else f"file://{a.path}"
            print(json.dumps({"written": sorted(r.path for r in E.write_files(result, root).collect())}))
        else:
            for r in E.diffs(g.sources, result).orderBy("path").toLocalIterator():
                print(r.diff, end="")
        return int(result.where("conflict is not null").limit(1).count() > 0)
    if a.command == "query":
        for line in session.lines(sys.stdin):
            print(line, flush=True)
        return 0
    if a.command == "serve":
        protocol.serve(session, port=a.port).serve_forever()
        return 0
    op = {"diagnose": "summary"}.get(a.command, a.command)
    request = {"op": op, "query": a.target if op == "symbols" else None, "file": a.target, "target": a.target, "depth": a.depth, "max_results": a.max_results, "kind": a.kind, "level": a.level, "raw": a.raw}
    request = {k: v for k, v in request.items() if v is not None}
    out = session.answer(request | ({"direction": a.direction} if op == "callgraph" else {}))
    if a.command == "diagnose":
        out["elapsed_seconds"] = round(time.perf_counter() - began, 3)
    print(json.dumps(out, indent=1, sort_keys=True, default=str))
    return int(not out["ok"])


if __name__ == "__main__":
    sys.exit(main())
