import pytest

from graphloom.plans.codegraph import CodeGraph

SHOP = {
    "shop/__init__.py": "from .api import Price as public_price\n",
    "shop/api.py": "from .money import Amount as Price\n",
    "shop/cart.py": "import json\nimport shop.money as money\nfrom shop.money import Amount\nfrom shop import public_price\n\n\ndef checkout(order):\n    first = Amount()\n    second = money.total(order)\n    third = public_price()\n    return json.dumps(first), second, third\n",
    "shop/money.py": "LIMIT = 10\n\n\nclass Amount:\n    pass\n\n\ndef total(items):\n    return Amount()\n",
}


@pytest.fixture(scope="module")
def shop(spark):
    return CodeGraph.from_files(spark, SHOP)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_files_and_symbols(shop):
    assert rows(shop.files, "id", "path", "module_name") == [(0, "shop/__init__.py", "shop"), (1, "shop/api.py", "shop.api"), (2, "shop/cart.py", "shop.cart"), (3, "shop/money.py", "shop.money")]
    assert rows(shop.symbols, "id", "file_id", "name", "kind") == [(0, 2, "checkout", "function"), (1, 3, "LIMIT", "global_variable"), (2, 3, "Amount", "class"), (3, 3, "total", "function")]


def test_imports_resolve_through_reexports(shop):
    got = {r.import_id: (r.target_file_id, r.target_symbol_id) for r in shop.import_resolutions.collect()}
    assert got == {0: (1, 2), 1: (3, 2), 3: (3, None), 4: (3, 2), 5: (0, 2)}
    assert [r.name for r in shop.external_modules.collect()] == ["json"]


def test_references_and_dependencies(shop):
    assert rows(shop.references, "id", "source_file_id", "source_symbol_id", "target_symbol_id", "import_id", "name") == [
        (0, 2, 0, 2, 4, "Amount"), (1, 2, 0, 3, 3, "total"), (2, 2, 0, 2, 5, "public_price"), (3, 3, 3, 2, None, "Amount"),
    ]
    assert rows(shop.external_references, "source_symbol_id", "import_id", "name") == [(0, 2, "json")]
    assert rows(shop.dependencies, "source_symbol_id", "target_symbol_id", "reference_ids", "reference_count") == [(0, 2, [0, 2], 2), (0, 3, [1], 1), (3, 2, [3], 1)]


def test_traces(shop):
    assert rows(shop.callgraph("checkout", depth=2), "source", "target", "depth") == [("checkout", "Amount", 1), ("checkout", "total", 1), ("total", "Amount", 2)]
    assert rows(shop.usages("shop/money.py::total"), "source", "target") == [("checkout", "total")]
    assert rows(shop.dead_code(), "name") == [("checkout",)]
    assert shop.summary()["references"] == 4


SCOPES = """
def helper(): pass

def param(helper): return helper
def local():
    helper = 1
    return helper
def loop():
    for helper in []: print(helper)
def context():
    with open('x') as helper: return helper
def caught():
    try: pass
    except ValueError as helper: return helper
def comp(): return [helper for helper in []]
def outside():
    x = [helper for helper in []]
    return helper
def lam(): return lambda helper: helper
def matched(v):
    match v:
        case [helper]: return helper
def nested():
    def helper(): pass
    return helper
def glob():
    global helper
    return helper
if True:
    def hidden(): pass
"""


def test_shadowing(spark):
    g = CodeGraph.from_string(spark, SCOPES, "python")
    name = {r.id: r.name for r in g.symbols.collect()}
    used = {name[r.source_symbol_id] for r in g.references.where("name = 'helper'").collect() if name[r.target_symbol_id] == "helper"}
    assert used == {"outside", "glob"}
    assert "hidden" not in name.values()


WILD = {
    "a.py": "__all__ = ['one']\ndef one(): pass\ndef two(): pass\n",
    "b.py": "from a import *\n",
    "c.py": "from b import *\nfrom d import *\ndef use():\n    one()\n    two()\n",
    "d.py": "from c import *\n__all__ = compute()\n",
    "e.py": "def f():\n    try:\n        import x.y\n    except ImportError:\n        pass\nclass Base: pass\nclass Child(Base):\n    def m(self, v: int, w=1): return self\n",
    "bad.py": "def (:\n",
}


def test_wildcards_errors_and_classes(spark):
    g = CodeGraph.from_files(spark, WILD)
    name = {r.id: r.name for r in g.symbols.collect()}
    assert {(name[r.source_symbol_id], name[r.target_symbol_id]) for r in g.references.collect()} == {("use", "one"), ("Child", "Base")}
    assert rows(g.files.where("has_error"), "path") == [("bad.py",)]
    assert [(name[r.source_symbol_id], name[r.target_symbol_id]) for r in g.subclass_edges.collect()] == [("Child", "Base")]
    assert rows(g.import_cycles(), "node") == [(3,), (4,)]  # c.py and d.py
    assert rows(g.parameters.where("name <> 'self'"), "name", "annotation", "has_default") == [("v", "int", False), ("w", None, True)]
    assert g.search_symbols("child.m").count() == 1


def test_empty_repository(spark):
    g = CodeGraph.from_files(spark, {"x.py": ""})
    assert g.references.count() == 0 and g.files.first().line_count == 0


def test_odd_literals_and_offsets(spark):
    g = CodeGraph.from_files(spark, {"x.py": "a = '\\udcff'\r\ndef f():\r\n    '\\ud800'\r\n    return 'é', a\r\n", "y.py": b"b = '\xff'\n", "z.py": "x = 1\x0c\ny = 2\n"})
    assert [r.value for r in g.string_literals.where("file_id = 0").orderBy("start_byte").collect()] == ["\\udcff", "\\ud800", "é"]
    assert g.files.where("has_error").count() == 0 and g.references.where("name = 'a'").count() == 1


def test_long_chains_of_reexports_are_resolved(spark, monkeypatch):
    from graphloom.plans import resolve

    monkeypatch.setattr(resolve, "MAX_ROUNDS", 2, raising=False)  # rounds are not limited, so a limit changes nothing
    files = {"m0.py": "def f():\n    pass\n"} | {f"m{i}.py": f"from m{i - 1} import f\n" for i in range(1, 7)}
    got = CodeGraph.from_files(spark, files)
    found = rows(got.import_resolutions, "target_symbol_id")
    assert found == [(0,)] * 6


def test_long_constants_are_told_apart(spark):
    long = "x" * 100
    tokens = CodeGraph.from_files(spark, {"a.py": f"def f():\n    return '{long}1' + '{long}2' + '{long}1'\n"}).tokens.where("group = 'operand' and token like 'sha256:%'").collect()
    assert len(tokens) == 3 and len({t.token for t in tokens}) == 2


def test_scans_follow_ignore_files(spark, tmp_path):
    from graphloom.sources import repo

    files = {".gitignore": "*.log\n/build/\n!keep.log\ndocs/**/x.py\n# no\n", "a.py": "", "sub/b.log": "", "sub/keep.log": "", "build/c.py": "", "sub/build/d.py": "", "docs/u/v/x.py": "", "sub/.gitignore": "e.py\n", "sub/e.py": "", "e.py": "", "x/y.min.js": "", "q@1.js": "", "z/compiled/k.py": "", "node_modules/m/n.js": ""}
    for p, t in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t or "x = 1\n")
    got = {r.path for r in repo.scan(spark, str(tmp_path)).select("path").collect()}
    assert got == {"a.py", "sub/keep.log", "sub/build/d.py", "e.py"}
    assert "sub/e.py" in {r.path for r in repo.scan(spark, str(tmp_path), gitignore=False).select("path").collect()}
