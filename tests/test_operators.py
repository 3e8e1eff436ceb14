"""Generic operators on small hand-made inputs: nulls, cycles, ties, empty tables."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.operators import aggregates as A
from graphloom.operators import joins as J
from graphloom.operators import traversal as T
from graphloom.sources import repo
from graphloom.sources.spans import Nest

EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 4), (6, 6), (None, 1), (1, None), (1, 2)]


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long")


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def test_traces(spark, edges):
    assert rows(T.trace(edges, nodes(spark, 1), 2)) == [(1, 2, 1), (2, 3, 2)]
    assert rows(T.trace(edges, nodes(spark, 4), 1, inbound=True)) == [(3, 4, 1), (5, 4, 1)]
    assert rows(T.trace(edges, nodes(spark, 1), 9)) == [(1, 2, 1), (2, 3, 2), (3, 1, 3), (3, 4, 3)]
    assert T.trace(edges, nodes(spark, 1), 0).count() == 0 and len(T.trace(edges, nodes(spark, 1), 9, max_results=2).collect()) == 2
    assert rows(T.reach(edges, nodes(spark, 1, 5))) == [(1, 2, 1), (1, 3, 2), (1, 4, 3), (5, 4, 1)]


def test_cycles_orders_and_dead_nodes(spark, edges):
    assert rows(T.strongly_connected(edges)) == [(1, 1), (2, 1), (3, 1)]
    level = dict(rows(T.topological_levels(edges, nodes(spark, 1, 2, 3, 4, 5, 6))))
    assert level[1] == level[2] == level[3] == 0 and level[4] == 1 and level[5] == 0
    assert rows(T.dead(nodes(spark, 4, 5, 6), edges.where("src is not null"))) == [(5, 1), (6, 1)]
    chain = spark.createDataFrame([(1, 2), (2, 3), (8, 9), (9, 8)], "node long, next long")
    got = dict(rows(T.follow(chain)))
    assert got[1] == got[2] == 3 and got[8] is None
    assert rows(T.induced(edges, nodes(spark, 1, 2, 4))) == [(1, 2), (1, 2)]
    assert T.strongly_connected(edges.where("src = 5")).count() == 0


def test_ladder_and_last_wins(spark):
    probe = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id long, k string")
    one = spark.createDataFrame([("a", 10), ("a", 11), ("b", None)], "k1 string, v1 long")
    two = spark.createDataFrame([("b", 20), ("a", 21)], "k2 string, v2 long")
    got = J.ladder(probe, [(one, [("k", "k1")], "v1"), (two, [("k", "k2")], "v2")], "v", "rung")
    assert rows(got, "id", "v", "rung") == [(1, 11, 1), (2, 20, 2), (3, None, None), (4, None, None)]
    assert rows(J.last_wins(spark.createDataFrame([("k", 1, "x"), ("k", 2, None)], "k string, o int, v string"), ["k"], ["o"])) == [("k", 2, None)]


def test_spans_and_as_of(spark):
    points = spark.createDataFrame([(1, 1, 2, 3), (2, 1, 50, 51), (3, 2, 2, 3)], "row long, g long, a long, b long")
    spans = spark.createDataFrame([(7, 1, 0, 10), (8, 1, 1, 5), (9, 1, 1, 5)], "id long, g long, a long, b long")
    assert rows(J.innermost(points, spans, "g", "a", "b", "id"), "row", "container") == [(1, 8), (2, None), (3, None)]
    uses = spark.createDataFrame([(1, "x", 5), (2, "x", 9), (3, "y", 5)], "id long, n string, at long")
    defs = spark.createDataFrame([("x", 5, "p"), ("x", 7, "q")], "n string, at long, v string")
    assert rows(J.as_of(uses, defs, ["n"], "at", ["v"]), "id", "prev_v") == [(1, None), (2, "q"), (3, None)]
    assert rows(J.as_of(uses, defs, ["n"], "at", ["v"], strict=False), "id", "prev_v") == [(1, "p"), (2, "q"), (3, None)]
    n = Nest([(0, 100, 1), (10, 50, 2), (10, 50, 3), (20, 30, 4), (60, 70, 5)])
    assert [n.innermost(*s) for s in ((25, 26), (40, 41), (55, 58), (65, 66), (20, 60), (200, 201))] == [4, 2, 1, 5, 1, None]


def test_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(S.python_module(lit("a/b/__init__.py"))) == "a.b" and one(S.python_module(lit("__init__.py"))) == "__init__"
    assert one(S.absolute_module(lit("..x"), lit("a.b"))) == "a.x" and one(S.absolute_module(lit("...x"), lit("a"))) is None
    assert one(S.normal_path(lit("a/b"), lit("../c/./d"))) == "a/c/d" and one(S.normal_path(lit("a"), lit("../../x"))) is None
    assert one(S.from_import_names(lit("(a, # c\n b as c,\n)"))) == ["a", "b as c"]
    assert one(S.string_value(lit("rb'''x'''"))) == "x" and one(S.string_value(lit("x"))) is None
    assert one(S.apply_pattern(lit("@a/*"), lit("@a/b"))) == "b" and one(S.apply_pattern(lit("@a"), lit("@b"))) is None
    assert one(S.byte_slice(lit("éab"), lit(2), lit(3))) == "a"
    assert [one(A.line_count(lit(t))) for t in ("", "a", "a\n", "a\nb")] == [0, 1, 1, 2]
    assert one(S.typescript_candidates(lit("a")))[:2] == ["a", "a.ts"]


def test_sources(spark, tmp_path):
    for p in ("a.py", "node_modules/x.py", "sub/b.py", "c.md"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    assert rows(repo.scan(spark, str(tmp_path), extensions=("py",)), "path") == [("a.py",), ("sub/b.py",)]
    assert rows(repo.scan(spark, str(tmp_path), subdirs=("sub",)), "path") == [("sub/b.py",)]
    assert repo.detect_language(repo.scan(spark, str(tmp_path))) == "python"
    f = spark.createDataFrame([("src/a.py",), ("docs/x.md",), ("y",)], "path string")
    assert rows(repo.owners(f, "* @all\n/docs/ @writers # c\n*.py @dev @ops\n")) == [("docs/x.md", "@writers"), ("src/a.py", "@dev"), ("src/a.py", "@ops"), ("y", "@all")]
    patch = "--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@\n@@ -9 +11 @@\n"
    got = repo.changed_lines(spark.createDataFrame([("x", patch), ("gone", "+++ /dev/null\n@@ -1 +0,0 @@")], "path string, patch string"))
    assert rows(got) == [("x", 11, 1), ("x", 3, 4)]
    assert repo.fnv1a(b"") == "cbf29ce484222325" and repo.is_minified("a" * 3000) and not repo.is_minified("let a = 1;\n" * 50)
    assert repo.strip_jsonc('{"a": "//x", /* c */ "b": [1,],}') == '{"a": "//x",  "b": [1]}'


def test_hot_keys_span_ranges(spark, request):
    from graphloom.operators import rows as W

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    df = spark.range(1000).select((F.col("id") % 7 == 3).cast("string").alias("k"), (F.col("id") * 37 % 1000).alias("t"), "id")
    plain = {r.id: r.place for r in W.place_within(df, ["k"], ["t"]).collect()}
    assert {r.id: r.place for r in W.place_over_ranges(df, ["k"], ["t"]).collect()} == plain
    assert W.ranged(df, ["k"], ["t"]).where("k = 'false'").select("_part").distinct().count() > 1
    left = df.where("id % 3 = 0")
    right = df.where("id % 50 = 1").select("k", "t", F.col("id").alias("v"))
    got = {r.id: r.prev_v for r in J.as_of(left, right, ["k"], "t", ["v"]).collect()}
    defs = [(r.k, r.t, r.v) for r in right.collect()]
    want = {r.id: max(((t, v) for k, t, v in defs if k == r.k and t < r.t), default=(0, None))[1] for r in left.collect()}
    assert got == want
    assert A.flag_groups(df.limit(0), "k", 10, ["t"]).count() == 0


def test_rows(spark):
    from graphloom.operators import rows as W

    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "a", None), (2, "a", "y")], "k int, v string, g string")
    assert {(r.k, r.n) for r in W.distinct_per(df, "k", "v", "n").collect()} == {(1, 2), (2, 1)}
    assert [r.k for r in W.distinct_per(df, "k", "v", "n", 2).collect()] == [1]
    assert {tuple(r) for r in W.by_kind(df, "k", "v", {"a": "as", "b": "bs"}).collect()} == {(1, 1, 1), (2, 2, 0)}
    assert W.main_kind(df, "g", 0.5, "other", "m").first().m == "x" and W.main_kind(df, "g", 0.9, "other", "m").first().m == "other"
    assert W.main_kind(df.limit(0), "g", 0.9, "other", "m").first().m == "other"
    assert {tuple(r) for r in W.differences(df.select("k"), spark.createDataFrame([(1,), (3,)], "k int")).collect()} == {("missing", 3), ("added", 1)}
    assert W.one_row((df, [F.count("*").alias("n")]), (df.limit(0), [F.sum("k").alias("s")])).first().asDict() == {"n": 4, "s": None}
    assert {tuple(r) for r in W.pair_counts(df, "k", "v", F.col("g").isNotNull(), "yes", "no").collect()} == {(2, "a", 1, 1)}
