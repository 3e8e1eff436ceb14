"""Edits of classes, collections, exports and namespaces, expression helpers, sessions, skills, resolvers."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import expressions as X
from graphloom.operators import edits as E
from graphloom.plans import codemods as M
from graphloom.plans import rewrites as RW
from graphloom.plans import views as V
from graphloom.plans.codegraph import RUNTIME, CodeGraph


def after(g, edits):
    rows = E.apply(g.sources, edits).collect()
    assert not [r.conflict for r in rows if r.conflict]
    return {r.path: bytes(r.content).decode() if r.content is not None else None for r in rows}


def test_expressions():
    assert X.binary_parts("a + b * c - f(x + 1)") == {"operands": ["a", "b", "c", "f(x + 1)"], "operators": ["+", "*", "-"]}
    assert X.binary_parts("a and b or not c") == {"operands": ["a", "b", "not c"], "operators": ["and", "or"]}
    assert X.binary_parts("1 < x <= 3") == {"operands": ["1", "x", "3"], "operators": ["<", "<="]} and X.binary_parts("f(a)") is None
    assert X.attribute_chain("a.b(1, x.y).c[0].d()") == ["a", "b(1, x.y)", "c", "d()"] and X.attribute_chain("x") == ["x"]
    assert X.signature("async def f(a: int = ':', *b) -> dict[str, int]:\n    return a") == "async def f(a: int = ':', *b) -> dict[str, int]"
    assert X.signature("export function f<T>(a: {b: string},\n  c = 1): T {\n return c }") == "export function f<T>(a: {b: string}, c = 1): T"
    assert X.signature("const g = async (a) => a + 1") == "const g = async (a)"
    assert X.generics("Dict[str, List[int]]") == {"name": "Dict", "arguments": ["str", "List[int]"]} and X.generics("int") is None
    assert X.generics("Map<string, Array<number>>")["arguments"] == ["string", "Array<number>"] and X.substitute("Map<K, V[]>", {"K": "string", "V": "number"}) == "Map<string, number[]>"
    assert X.insert_item("[1, 2]", 1, "9") == "[1, 9, 2]" and X.insert_item("()", 0, "1") == "(1,)" and X.insert_item("f(a)", -1, "b=2") == "f(a, b=2)"
    assert X.insert_item("[\n    1,\n    2,\n]", 2, "3") == "[\n    1,\n    2,\n    3,\n]"
    assert X.remove_item("[a, 'b, c', d]", "'b, c'") == "[a, d]" and X.remove_item("{a: 1, b: 2}", "a") == "{b: 2}" and X.remove_item("[1, 2, 3]", -1) == "[1, 2]"
    assert X.set_item("{'a': 1}", "'b'", "2") == "{'a': 1, 'b': 2}" and X.set_item("{'a': 1}", "'a'", "2") == "{'a': 2}"
    assert X.reduce_operation("flag and a", "flag", True) == "a" and X.reduce_operation("flag or a", "flag", True) == "True" and X.reduce_operation("not flag or a", "flag", True) == "a"
    assert X.reduce_operation("a if flag else b", "flag", False) == "b" and X.reduce_operation("x if a else y", "flag", False) == "x if a else y"
    assert X.unwrap_unpacking("f(*[a, b], **{'c': 1}, *rest)") == "f(a, b, c=1, *rest)"
    assert X.arrow_to_named("export const f = async (a: number): Promise<void> => { go(a); };") == "export async function f(a: number): Promise<void> { go(a); }"
    assert X.arrow_to_named("const g = x => x + 1") == "function g(x) { return x + 1; }" and X.arrow_to_named("let y = 3") == "let y = 3"
    assert X.props_to_interface("export function C({ a, b }: { a: string; b: number }) {}") == "export interface CProps {\n  a: string;\n  b: number;\n}\n\nexport function C({ a, b }: CProps) {}"
    assert X.truncated("abcdef", 5) == "ab..." and X.truncated("abc", 5) == "abc"
    assert X.compiled("return 3 + len(arguments)")(None, a=1) == 4


PY = {
    "app/m.py": "import enum\n\n\nclass A:\n    x = 1\n    mode = NullSession\n\n    def go(self, y):\n        return self.go(y)\n\n    @staticmethod\n    def free(z):\n        return z\n\n\nclass B(enum.Enum):\n    'doc'\n    ONE = 1\n\n\nnames = ['a', 'b']\ntable = {'k': 1}\n\n\ndef lonely(c):\n    if c:\n        v = 1\n    else:\n        v = 2\n    return v\n",
    "app/n.py": "from app.m import A, names\n\n\nasync def run():\n    await other(1)\n    return other(A)\n\n\ndef other(a, b=2):\n    return names\n",
    "old/config.py": "VALUE = 1\n",
    "app/u.py": "from magic.config import VALUE\nprint(VALUE)\n",
}


@pytest.fixture(scope="module")
def g(spark):
    return CodeGraph.from_files(spark, PY)


def test_class_edits(g):
    got = after(g, RW.add_attribute(g, g.resolve_target("A"), "z = 3"))["app/m.py"]
    assert "    mode = NullSession\n    z = 3\n" in got
    assert "    'doc'\n    ONE = 1\n    TWO = 2\n" in after(g, RW.add_attribute(g, g.resolve_target("B"), "TWO = 2"))["app/m.py"]
    got = after(g, RW.add_source(g, g.resolve_target("A"), "def new(self):\n    return 1"))["app/m.py"]
    assert "        return z\n\n    def new(self):\n        return 1\n" in got
    assert "x = 1" not in after(g, RW.remove_attribute(g, g.resolve_target("A"), "x"))["app/m.py"]
    got = after(g, RW.declassify(g, g.resolve_target("A")))["app/m.py"]
    assert "class A" not in got and "\nx = 1\n" in got and "\ndef go(y):\n    return go(y)\n" in got and "\ndef free(z):\n    return z\n" in got
    compile(got, "m", "exec")


def test_collections_and_arguments(g):
    got = after(g, RW.edit_value(g, g.resolve_target("names"), lambda s: X.insert_item(s, 0, "'z'")))["app/m.py"]
    assert "names = ['z', 'a', 'b']" in got
    assert "table = {'k': 1, 'n': 2}" in after(g, RW.edit_value(g, g.resolve_target("table"), lambda s: X.set_item(s, "'n'", "2")))["app/m.py"]
    got = after(g, RW.edit_arguments(g, g.resolve_target("other"), lambda s: X.insert_item(s, -1, "b=5")))["app/n.py"]
    assert "await other(1, b=5)" in got and "return other(A, b=5)" in got and "def other(a, b=2)" in got


def test_questions(g):
    sig = {r.name: r.signature for r in RW.signatures(g).collect()}
    assert sig["other"] == "def other(a, b=2)" and sig["run"] == "async def run()"
    calls = {(r.name, r.is_awaited) for r in RW.awaited_calls(g).where("name = 'other'").collect()}
    assert calls == {("other", True), ("other", False)}
    assert [(r.name, r.branches) for r in RW.conditional_definitions(g).collect()] == [("v", 2)]
    urls = [r.url for r in RW.source_urls(g, "https://host/x/", "v1").collect()]
    assert "https://host/x/blob/v1/old/config.py#L1-L1" in urls
    kinds = {r.kind: r.n for r in V.callables(g).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"function": 3, "method": 2}
    assert V.widely_used(g, 1).count() >= 2 and V.directory_subtotals(g).where("directory is null and language is null").first().files == 4


def test_codemods(spark, g):
    got = after(g, M.run("convert_attribute_to_decorator", g, values={"NullSession": "null_session"}, module="sessions"))["app/m.py"]
    assert "@null_session\nclass A:" in got and "mode" not in got and "from sessions import null_session" in got
    assert "def _lonely(c)" in after(g, M.run("mark_internal_to_module", g))["app/m.py"]
    got = after(g, M.run("split_file", g, path="app/m.py", to="app/enums.py"))
    assert "class B" in got["app/enums.py"] and "class B" not in got["app/m.py"]
    api = CodeGraph.from_files(spark, {"r.py": "@x_ns.route('/')\nclass ThingResource(R):\n    def get(self):\n        return 1\n\n    def post(self):\n        return request.json\n\n    @x_ns.expect(f)\n    def put(self):\n        return 2\n"})
    got = after(api, M.run("openapi_no_reference_request", api))["r.py"]
    assert got.count("expect(None)") == 1 and "    @x_ns.expect(None)\n    def get(self)" in got
    two = CodeGraph.from_files(spark, {"t.py": "class Configuration:\n    pass\n\n\nclass Other:\n    pass\n", "w.py": "from t import Configuration, Other\nprint(Configuration, Other)\n"})
    src = {r.path: bytes(r.content).decode() for r in M.split_file_and_rename_symbols(two, "t.py", "conf.py", "Configuration", "Configuration", "Config").collect()}
    assert "class Config:" in src["conf.py"] and "Configuration" not in src["t.py"] and "Config" in src["w.py"] and "Configuration" not in src["w.py"]
    swap = CodeGraph.from_files(spark, {"s.py": "def f(rag: RagConfig, k):\n    return rag.size + k\n\n\ndef g(c):\n    return f(c, 1)\n"})
    got = after(swap, M.run("swap_class_attribute_usages", swap, old="RagConfig", new="CacheConfig", parameter="cache_config", attribute="settings", module="conf"))["s.py"]
    assert "def f(cache_config: CacheConfig, k)" in got and "    rag = cache_config.settings\n    return" in got and "f(c.cache_config, 1)" in got and "from conf import CacheConfig" in got


TS = {
    "a.ts": "export default function run(x: number) { return x; }\nnamespace N {\n  export function p() {}\n  function q() {}\n}\n",
    "b.ts": "import go, { p } from './a';\nimport run from './a';\ngo(run(1));\n",
    "index.ts": "export * from './a';\n",
}


def test_exports_and_namespaces(spark):
    g = CodeGraph.from_files(spark, TS)
    got = after(g, RW.make_non_default(g, g.resolve_target("run")))
    assert got["a.ts"].startswith("export function run(") and got["b.ts"].startswith("import { run as go, p } from './a';\nimport { run } from './a';\n")
    assert after(g, RW.reexport(g, g.resolve_target("run"), "index.ts", "./a"))["index.ts"] == "export * from './a';\nexport { run } from './a';\n"
    assert RW.reexports(g, "./a.ts").count() == 1
    n = g.symbols.where("name = 'N'").select("id")
    assert "  export function q() {}" in after(g, RW.export_in_namespace(g, n, "q"))["a.ts"]
    assert "  export const z = 1;\n}" in after(g, RW.add_to_namespace(g, n, "const z = 1;"))["a.ts"]
    assert "function q" not in after(g, RW.remove_from_namespace(g, n, "q"))["a.ts"]
    assert "function qq()" in after(g, RW.rename_in_namespace(g, n, "q", "qq"))["a.ts"]


def test_sessions_skills_and_resolvers(spark, g):
    s = E.Session(most=1)
    s.add(E.listed(spark, [("old/config.py", "insert", 0, 0, "# a\n")]))
    with pytest.raises(E.Limit):
        s.add(E.listed(spark, [("old/config.py", "insert", 0, 0, "# b\n")]))
    both = E.Session(seconds=1000)
    both.add(E.listed(spark, [("old/config.py", "insert", 0, 0, "# a\n")]))
    both.add(E.listed(spark, [("app/u.py", "insert", 0, 0, "# b\n")]))
    only = spark.createDataFrame([("app/u.py",)], "path string")
    assert {r.path: r.status for r in both.commit(g.sources, only).collect() if r.status != "unchanged"} == {"app/u.py": "modified"}
    with pytest.raises(E.Limit):
        E.Session(seconds=-1).add(E.listed(spark, []))
    skill = M.Skill("update_optional_types", "python", [({"a.py": "x: Optional[int] = None\n"}, {"a.py": "x: int | None = None\n"})])
    assert skill.check(spark) == [{}]
    M.from_source("return R.search(g, 'VALUE', 'WORTH')", "worth")
    assert after(g, M.run("worth", g))["old/config.py"] == "WORTH = 1\n"
    known = lambda imports, files: imports.where("module = 'magic.config'").select(F.col("id").alias("import_id"), F.lit("old/config.py").alias("path"))
    own = CodeGraph(spark, g.sources, "python", resolver=known)
    assert own.references.count() == g.references.count() + 1


def test_runtime_calls_are_the_fixed_set():
    assert len(RUNTIME) == 46 and {"forEach", "Promise", "getattr", "log"} <= RUNTIME and "print" not in RUNTIME
