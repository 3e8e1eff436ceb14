import json
import threading
import urllib.request

import pytest

from graphloom.functions import text as X
from graphloom.operators import edits as E
from graphloom.plans import codemods, endpoints, protocol
from graphloom.plans.codegraph import CodeGraph

CHAIN = {
    "app/core.py": "import typing\nfrom typing import List, Optional\n\n\ndef low(x: List[int]) -> str:\n    return str(len(x))\n\n\ndef mid(x):\n    print(x)\n    return low(x)\n\n\ndef high(x: Optional[int] = None):\n    mid(x)\n",
    "app/__init__.py": "from app.core import high\n",
    "app/use.py": "from app import high\n\n\ndef main():\n    if FLAG:\n        high(1)\n    else:\n        high(2)\n",
}


@pytest.fixture(scope="module")
def session(spark):
    return protocol.Session(lambda: CodeGraph.from_files(spark, CHAIN))


def test_ops(session):
    ask = session.answer
    assert ask({"op": "summary", "id": 7})["result"]["files"] == 3 and ask({"op": "summary", "id": 7})["id"] == 7
    edges = ask({"op": "callgraph", "target": "high", "depth": 2})["result"]["edges"]
    assert [(e["source"], e["target"], e["depth"]) for e in edges] == [("high", "mid", 1), ("mid", "low", 2)]
    raw = ask({"op": "callgraph", "target": "mid", "depth": 1, "raw": True})["result"]["edges"]
    assert [(e["target"], e["call"]) for e in raw] == [(None, "print"), ("low", "low")]
    used = ask({"op": "usages", "target": "app/core.py::low"})["result"]["edges"]
    assert [(e["source"], e["location"]) for e in used] == [("mid", "app/core.py:11")]
    assert [e["target"] for e in ask({"op": "using", "target": "mid", "resolved_only": True})["result"]["edges"]] == ["low"]
    assert [s["name"] for s in ask({"op": "symbols", "query": "CORE"})["result"]["symbols"]] == ["low", "mid", "high"]
    assert ask({"op": "inspect", "file": "core.py", "level": "calls", "max_calls": 1})["result"]["functions"][0] == {"name": "low", "line": 5, "calls_count": 2, "calls": ["str"]}
    assert ask({"op": "status"})["result"]["stale"] is False and ask({"op": "reload"})["result"]["reloaded"]


def test_bad_requests(session):
    for request, message in [({"op": "nope"}, "unsupported"), ({"op": "callgraph"}, "target is required"), ({"op": "usages", "target": "low", "depth": -1}, "depth must be >= 0"), ({"op": "symbols", "kind": "x"}, "kind must be one of"), ({"op": "usages", "target": "low", "dedupe": 1}, "dedupe must be a boolean"), ({"op": "usages", "target": "none"}, "no symbol")]:
        got = session.answer(request)
        assert not got["ok"] and message in got["error"]["message"]
    out = [json.loads(x) for x in session.lines(['{"op": "status"}', "", "{", '{"op": "exit"}', '{"op": "status"}'])]
    assert [o["ok"] for o in out] == [True, False, True] and out[1]["line"] == 3


def test_http(session):
    server = protocol.serve(session)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    body = json.dumps({"op": "status"}).encode()
    with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}", body)) as r:
        assert json.loads(r.read())["ok"]
    server.shutdown()


def after(g, edits):
    return {r.path: bytes(r.content).decode() for r in E.apply(g.sources, edits).collect()}


def test_python_codemods(spark, session):
    g = session.graph
    got = after(g, codemods.run("built_in_type_annotation", g))["app/core.py"]
    assert "from typing import Optional\n" in got and "x: list[int]" in got
    assert "x: int | None = None" in after(g, codemods.run("update_optional_types", g))["app/core.py"]
    assert after(g, codemods.run("remove_indirect_imports", g))["app/use.py"].startswith("from app.core import high\n")
    assert "def high(x: Optional[int] = None) -> None:" in after(g, codemods.run("return_none_type_annotation", g))["app/core.py"]
    assert after(g, codemods.run("reduce_feature_flag", g, condition="FLAG", value=False))["app/use.py"].endswith("def main():\n    high(2)\n")
    pivoted = after(g, codemods.run("pivot_return_types", g))["app/core.py"]
    assert "-> FastStr:" in pivoted and "from fast_str import FastStr\n" in pivoted
    assert "    with t():\n        print(x)\n        return low(x)\n" in after(g, codemods.run("wrap_with_statement", g, target="mid", header="with t()"))["app/core.py"]
    assert "high(x=1)" in after(g, codemods.run("use_named_kwargs", g, at_least=1))["app/use.py"]
    with pytest.raises(ValueError):
        codemods.run("bang_bang_to_boolean", g)
    assert len(codemods.listing()) >= 30


def test_typescript_codemods(spark):
    g = CodeGraph.from_files(spark, {"a.ts": "// adds\nexport function addUp(flag: boolean, xs: Array<string>) { const s = '!!x'; return !!xs && flag; }\ninterface my_shape { a: string }\nlet q: my_shape;\nasync function f() { go().then(r => use(r)).catch(e => log(e)); }\n", "b.js": "const x = require('y');\nmodule.exports = x;\n"})
    a = after(g, codemods.run("bang_bang_to_boolean", g))["a.ts"]
    assert "Boolean(xs) && flag" in a and "'!!x'" in a
    assert "xs: string[]" in after(g, codemods.run("array_type_to_square_bracket", g))["a.ts"]
    assert "addUp(isFlag: boolean" in (m := after(g, codemods.run("mark_is_boolean", g))["a.ts"]) and "&& isFlag" in m
    assert "interface MyShape" in (m := after(g, codemods.run("pascal_case_symbols", g))["a.ts"]) and "let q: MyShape" in m
    assert after(g, codemods.run("js_to_esm", g))["b.js"] == "import x from 'y';\nexport default x;\n"
    assert after(g, codemods.run("comments_to_jsdoc", g))["a.ts"].startswith("/**\n * adds\n */\nexport function")
    assert "const r = await go();\n  use(r);\n} catch (e) {\n  log(e);\n}" in after(g, codemods.run("promises_to_async", g))["a.ts"]


def test_endpoints(spark):
    server = CodeGraph.from_files(spark, {"s.py": "@app.route('/users/<int:id>', methods=['GET', 'POST'])\ndef user(id): pass\n@app.get('/ping')\ndef ping(): pass\n"})
    client = CodeGraph.from_files(spark, {"c.ts": "export const load = (id) => axios.get(`/users/${id}`);\nexport const up = () => fetch('/up', {method: 'put'});\n"})
    got = {(r.method, r.url): (len(r.definitions), len(r.usages)) for r in endpoints.link(endpoints.scan(server).unionAll(endpoints.scan(client))).collect()}
    assert got == {("GET", "/users/{}"): (1, 1), ("POST", "/users/{}"): (1, 0), ("GET", "/ping"): (1, 0), ("PUT", "/up"): (0, 1)}


def test_text_functions():
    assert X.relative_module("src/a/b.ts", "src/c.ts") == "../c" and X.relative_module("a.ts", "b.tsx") == "./b"
    d = X.parse_docstring("Adds.\n\nArgs:\n    a (int): first\n    b: second\n\nReturns:\n    sum")
    assert d == {"description": "Adds.", "arguments": [{"name": "a", "type": "int", "description": "first"}, {"name": "b", "type": None, "description": "second"}], "returns": "sum"}
    assert X.google_docstring("Adds.\n\n:param int a: first\n:returns: sum") == "Adds.\n\nArgs:\n    a (int): first\n\nReturns:\n    sum"
    assert X.from_xml(X.to_xml({"a": 1, "b": [{"c": "x"}, {"c": "y"}]})) == {"root": {"a": "1", "b": [{"c": "x"}, {"c": "y"}]}}
    assert X.reduce_condition("if a:\n    x\nelif b:\n    y\nelse:\n    z\n", "a", False) == "if b:\n    y\nelse:\n    z\n"
    assert X.reduce_condition("def f():\n    if not a:\n        x\n", "a", True) == "def f():\n    pass\n"
    assert X.modern_annotations("x: Optional[Union[int, List[str]]]") == "x: int | List[str] | None"
    assert X.literal("{'a': [1]}") == {"a": [1]} and X.literal("f()") is None
