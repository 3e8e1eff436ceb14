import json

import pytest
from pyspark.sql import functions as F

from graphloom.plans import views as V
from graphloom.plans.codegraph import USAGE_TYPES, CodeGraph

FILES = {
    "pkg/__init__.py": "from .base import Base\n",
    "pkg/base.py": "class Root:\n    kind: str = 'r'\n    shared = 1\n\n    def go(self):\n        return self.stop()\n\n    def stop(self):\n        return 1\n\n\nclass Base(Root):\n    shared = 2\n\n    @property\n    def size(self):\n        return 3\n\n    @staticmethod\n    def make():\n        pass\n",
    "pkg/use.py": "import pkg.base as b\nfrom pkg import Base\nfrom pkg.base import Root as R\n\n\nclass Leaf(Base):\n    def __init__(self):\n        x = 1\n        y = x\n        print('text here', x)\n\n\ndef build():\n    R()\n    b.Root()\n    return Base().go().run()\n",
    "loop_a.py": "import loop_b\ndef late():\n    import loop_b\n",
    "loop_b.py": "import loop_a\n",
}


@pytest.fixture(scope="module")
def g(spark):
    return CodeGraph.from_files(spark, FILES)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_classes(g):
    name = {r.id: r.name for r in g.symbols.collect()}
    got = {(name[r.class_id], r.name, r.level) for r in V.attributes(g).collect()}
    assert {("Base", "shared", 0), ("Leaf", "shared", 1), ("Leaf", "kind", 2), ("Root", "shared", 0)} <= got
    assert {name[r.id] for r in V.is_subclass_of(g, "x.Root").collect()} == {"Base", "Leaf"}
    assert {(name[r.class_id], r.depth) for r in V.inheritance_depth(g).collect()} == {("Root", 0), ("Base", 1), ("Leaf", 2)}
    assert rows(V.method_graph(g, "Root")) == [("go", "stop")]
    assert rows(V.resolve_attribute(g, "Leaf", "stop"), "kind", "level") == [("method", 2)]
    p = {r.name: r for r in V.predicates(g).collect()}
    assert p["size"].is_property and p["make"].is_static_method and p["__init__"].is_constructor and p["__init__"].is_magic and p["build"].is_method is False


def test_usages(g):
    name = {r.id: r.name for r in g.symbols.collect()}
    got = {(name[r.target_symbol_id], r.name, r.usage_type) for r in V.usages(g).collect()}
    assert {("Root", "R", USAGE_TYPES["aliased"]), ("Root", "Root", USAGE_TYPES["chained"]), ("Base", "Base", USAGE_TYPES["indirect"]), ("Root", "Root", USAGE_TYPES["direct"])} <= got
    assert V.usages(g, USAGE_TYPES["chained"]).count() == 1
    with pytest.raises(ValueError):
        V.usages(g, USAGE_TYPES["direct"] | USAGE_TYPES["aliased"])
    assert {(name[r.target_symbol_id], r["call"], r.subclass) for r in V.usage_summary(g).collect()} == {("Root", 2, 1), ("Base", 1, 1)}
    assert {(name[r.symbol_id], r.is_indirect) for r in V.import_chain(g).collect()} == {("Base", False), ("Base", True), ("Root", False)}


def test_scopes_and_lookups(g):
    name = {r.id: r.name for r in g.symbols.collect()}
    assert {(name[r.symbol_id], r.name) for r in V.unused_locals(g).collect()} == {("__init__", "y")}
    local = [r for r in V.resolve_local(g).where("name = 'x'").collect()]
    assert len(local) == 2 and len({r.defined_at for r in local}) == 1 and local[0].defined_at is not None
    assert rows(V.names_in_file(g, "pkg/use.py"), "name", "kind") == [("Base", "import"), ("Leaf", "symbol"), ("R", "import"), ("b", "import"), ("build", "symbol")]
    assert rows(V.find(g, "text"), "text", "kind") == [("text here", "string")] and V.find(g, ["shared"], exact=True).count() == 2
    assert {r.name for r in V.variable_usages(g).collect()} >= {"x", "self"} and V.assignments(g, "sha", fuzzy=True).count() == 2
    start = FILES["pkg/use.py"].index("b.Root()")
    assert [r.kind for r in V.by_span(g, "pkg/use.py", start, start + 1).collect()][0] == "identifier"
    assert rows(V.definition_at(g, "pkg/use.py", FILES["pkg/use.py"].index("Base().go")))[0][0] == "pkg/base.py"
    assert rows(V.document_symbols(g, "pkg/use.py"), "name", "parent") == [("Leaf", None), ("__init__", "Leaf"), ("build", None)]
    patch = g.spark.createDataFrame([("pkg/use.py", "@@ -1 +14,2 @@")], "path string, patch string")
    assert rows(V.modified_symbols(g, patch), "name") == [("build",)]
    assert V.statements(g, "return", 2).count() == 4 and V.descendants(g, g.resolve_target("Root")).count() == 2


def test_imports_and_files(g):
    kinds = {(r.name, r.is_aliased, r.is_module, r.is_symbol) for r in V.import_predicates(g).collect()}
    assert {("pkg.base", True, True, False), ("Root", True, False, True), ("Base", False, False, True)} <= kinds
    paths = {r.id: r.path for r in g.files.collect()}
    assert [(paths[r.source_file_id], r.dynamic_imports, r.static_imports) for r in V.mixed_import_loops(g).collect()] == [("loop_a.py", 1, 1)]
    level = dict(rows(V.topological_files(g)))
    assert level["loop_a.py"] == level["loop_b.py"] and level["pkg/use.py"] < level["pkg/base.py"]
    assert V.directory(g, "pkg").count() == 3 and V.directory(g, "").count() == 2 and V.directory(g, "", True).count() == 5
    assert dict((r.directory, r.files) for r in V.directory_rollup(g).collect()) == {"": 5, "pkg": 3}
    assert V.files(g, ["py"]).count() == V.files(g, "*").count() == 5
    assert {(r.path, r.importers) for r in V.file_summary(g).collect()} >= {("pkg/base.py", 2), ("loop_a.py", 1)}
    assert {(r.file_id, r.name) for r in V.api(g).collect()} and V.call_sites(g, "pkg.base.Root").count() == 2
    chain = {r.name: r for r in V.call_chains(g).where("place > 0 or successor is not null").collect()}
    assert chain["go"].predecessor is not None and chain["run"].successor is None


def test_reports_and_sinks(g, spark, tmp_path):
    assert V.report(g)["classes"] == 3 and dict(rows(V.edge_summary(g)))["FILE"] == 5
    m = {r.path: r for r in V.line_metrics(spark.createDataFrame([("a.py", b"# c\nx = 1; y = ';'\n\nz = 2  # d\n")], "path string, content binary")).collect()}["a.py"]
    assert (m.loc, m.sloc, m.comments, m.lloc) == (4, 2, 2, 3)
    f = V.flags(g.symbols, "look", F.col("file_id"), 2)
    assert f.count() == g.symbols.count() and f.agg(F.max("chunk")).first()[0] >= 1
    v = json.loads(V.visual(g.edges, g.symbols))
    assert v["nodes"] and v["links"]
    assert any("INHERITS_FROM" in r.statement for r in V.cypher(g).collect())
    assert all(n == 0 for n in V.validate(g, g).values())
    V.write_json(g, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/symbols").count() == g.symbols.count()
