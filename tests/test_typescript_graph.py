import pytest

from graphloom.plans.codegraph import CodeGraph
from graphloom.sources.typescript_parser import extract
from graphloom.sources.typescript_syntax import parse

SHAPES = {
    "src/util.ts": "export function area(n: number) { return n; }\n",
    "src/index.ts": "export { area as publicArea } from './util';\nexport * as shapes from './util';\n",
    "src/app.ts": "import { area } from './util';\nimport { publicArea, shapes } from './index';\n\nexport function run() {\n  return area(publicArea(1)) + shapes.area(2);\n}\n",
}


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def names(g):
    return {r.id: r.name for r in g.symbols.collect()}


@pytest.fixture(scope="module")
def shapes(spark):
    return CodeGraph.from_files(spark, SHAPES)


def test_references_of_each_import(shapes):
    n = names(shapes)
    assert [(n[r.source_symbol_id], n[r.target_symbol_id], r.reference_count) for r in shapes.dependencies.collect()] == [("run", "area", 3)]
    assert sum(r.target_symbol_id is not None for r in shapes.calls.collect()) == 3
    assert rows(shapes.exports, "kind", "name", "local_name") == [("named", "area", "area"), ("named", "publicArea", "area"), ("named", "run", "run"), ("namespace", "shapes", "shapes")]


WIDE = {
    "tsconfig.json": '{\n // base\n "compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["lib/*"], "@lib/special": ["other/special.ts"],}},\n}',
    "inner/tsconfig.json": '{"compilerOptions": {"baseUrl": "./src"}}',
    "lib/math.ts": "export default function add(a: number, b = 1) { return a + b }\nexport const PI = 3.14;\nexport interface Shape { name: string; size?(): number }\n",
    "lib/all.ts": "export * from './math';\nexport { default as plus } from './math';\n",
    "other/special.ts": "export class Special {}\n",
    "legacy.js": "class Old {}\nexport = Old;\n",
    "inner/src/tool.ts": "export namespace Outer { export namespace Deep { export function go() {} } }\n",
    "inner/src/use.ts": "import { Outer } from 'tool';\nexport function user() { Outer.Deep.go(); }\n",
    "app.tsx": "import add, { PI as pi } from '@lib/math';\nimport { Special } from '@lib/special';\nimport { plus, Shape } from '@lib/all';\nimport Old from './legacy';\nimport React from 'react';\nimport * as m from './lib/math';\n"
    "export class Box extends Special implements Shape { name = 'x'; size() { return add(pi) } }\n"
    "export const View = (props: { a: string }) => { const inner = plus(1); return <div><Box title=\"t\" on={() => inner} /></div>; };\n"
    "function shadow(pi: number) { return pi + m.PI; }\n"
    "const load = () => fetch('x').then(r => r).catch(e => e);\nnew Old();\nReact.useState();\n",
}


@pytest.fixture(scope="module")
def wide(spark):
    return CodeGraph.from_files(spark, WIDE)


def test_modules_through_configurations(wide):
    path = {r.id: r.path for r in wide.files.collect()}
    got = {(path[r.source_file_id], path[r.target_file_id]) for r in wide.import_resolutions.collect()}
    assert got == {("app.tsx", "lib/math.ts"), ("app.tsx", "other/special.ts"), ("app.tsx", "lib/all.ts"), ("app.tsx", "legacy.js"), ("lib/all.ts", "lib/math.ts"), ("inner/src/use.ts", "inner/src/tool.ts")}
    assert rows(wide.external_modules, "module", "name") == [("react", "React")]


def test_references_by_priority(wide):
    n = names(wide)
    got = {(n.get(r.source_symbol_id), n[r.target_symbol_id]) for r in wide.references.collect()}
    assert got == {("Box", "Special"), ("Box", "Shape"), ("Box", "add"), ("Box", "PI"), ("inner", "add"), ("View", "Box"), ("View", "inner"), ("shadow", "PI"), (None, "Old"), ("user", "Outer"), ("user", "Deep"), ("user", "go")}
    assert {(n[r.source_symbol_id], n[r.target_symbol_id]) for r in wide.subclass_edges.collect()} == {("Box", "Special"), ("Box", "Shape")}
    assert rows(wide.external_references, "name") == [("React",)]


def test_markup_chains_and_members(wide):
    assert rows(wide.jsx_elements, "name") == [("Box",), ("div",)]
    assert rows(wide.jsx_props, "name", "value_is_expression") == [("on", True), ("title", False)]
    assert [r.stage_names for r in wide.promise_chains.collect()] == [["then", "catch"]]
    n = names(wide)
    assert {(n[r.symbol_id], r.name, r.kind, r.is_optional) for r in wide.members.collect()} == {("Shape", "name", "attribute", False), ("Shape", "size", "method", True), ("Box", "name", "attribute", False), ("Box", "size", "method", False)}
    assert rows(wide.parameters.where("has_default"), "name", "annotation") == [("b", None)]


def test_expressions_of_properties(spark):
    text = "const C = () => <B a={12} b={ x + 1 } c={/* k */ z} d={} e=\"s\" f g={{p: 'é'}} h={<I/>} i=<I/> />;\n"
    got = rows(CodeGraph.from_files(spark, {"a.tsx": text}).jsx_props, "name", "value", "value_is_expression", "expression")
    assert got == [
        ("a", "{12}", True, "12"), ("b", "{ x + 1 }", True, "x + 1"), ("c", "{/* k */ z}", True, "z"), ("d", "{}", True, None), ("e", '"s"', False, None),
        ("f", None, False, None), ("g", "{{p: 'é'}}", True, "{p: 'é'}"), ("h", "{<I/>}", True, "<I/>"), ("i", "<I/>", False, None),
    ]


@pytest.mark.parametrize(
    "text",
    [
        "const a = b < c ? d : (e) => f;", "const re = /[/]x/g.test(s) ? 1 / 2 : 3;", "x!.y?.z?.[0]?.(1);", "foo<string>(bar); a < b; c > (d);", "abstract class A { abstract f(): void; protected x: string }",
        "async function h({ a, b }: { a: string; b?: number }) { for await (const x of y) { if (x < 3 && y > 4) continue; } }", "let v = `a${b}c${`d${e}`}`;", "type U = { [K in keyof T]?: T[K] } & ((a: number) => string);",
        "const el = <>Don't {x /* c */} <A.B c:d='1' {...p}/></>;", "export default async () => {};", "label: for (;;) { break label }", "function f(x: any): x is string { return typeof x === 'string' }",
        "import type { T } from './t';\nexport type { T };", "const o = { async m() {}, get x() { return 1 }, [k]: 1, 'str': 2, 3: 4, ...s };", "declare module 'm' { export function z(): void }", "enum E { A = 1, B = 'x' }",
    ],
)
def test_grammar(text):
    assert parse(text)[1] == 0


def test_broken_statement_does_not_lose_the_rest():
    x = extract("const = ;\nexport function ok() { return 1 }\n")
    assert x.has_error and [s["name"] for s in x.symbols] == ["ok"]


def test_offsets_are_bytes():
    x = extract("const é = 1; const b = é;\n")
    assert (x.candidates[0]["range"]["start_byte"], x.candidates[0]["range"]["end_byte"]) == (24, 26)


def test_long_constants_are_told_apart(spark):
    long = "x" * 100
    tokens = CodeGraph.from_files(spark, {"a.ts": f"function f() {{ return '{long}1' + '{long}2' + '{long}1' }}\n"}, language="typescript").tokens.where("group = 'operand' and token like 'sha256:%'").collect()
    assert len(tokens) == 3 and len({t.token for t in tokens}) == 2


@pytest.mark.parametrize(("language", "path", "text"), [("typescript", "src/m%d.ts", "export class F%d {}"), ("python", "pkg/m%d.py", "def f%d(): pass")])
def test_sources_of_one_partition_are_parsed_by_many_tasks(spark, language, path, text):
    from pyspark.sql import functions as F

    from graphloom.sources import repo

    sources = spark.range(400).coalesce(1).select(F.format_string(path, "id").alias("path"), F.encode(F.format_string(text, "id"), "UTF-8").alias("content"))
    assert sources.rdd.getNumPartitions() == 1
    parsed = repo.parse(sources, language).select("path", F.size("symbols").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert sorted(r.path for r in parsed) == sorted(path % i for i in range(400)) and {r.n for r in parsed} == {1}
    share = [sum(r.task == k for r in parsed) for k in {r.task for r in parsed}]
    assert len(share) >= 4 and max(share) < 200
