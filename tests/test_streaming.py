import json

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import changes as C


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def change(spark, rows_):
    return spark.createDataFrame([(p, k, to, c.encode() if c is not None else None, None, i) for i, (p, k, to, c) in enumerate(rows_)], C.CHANGES)


SOURCES = [("a.py", b"x = 1\n"), ("b.py", b"y = 2\n"), ("c.txt", b"z")]
CHANGES = [("a.py", "added", None, "v = 0\n"), ("a.py", "modified", None, "x = 5\n"), ("b.py", "renamed", "d.py", "y = 2\n"), ("new.py", "modified", None, "n = 1\n"), ("gone.py", "removed", None, None), ("c.txt", "removed", None, None)]


def test_actions_last_wins_and_promotions(spark):
    src = spark.createDataFrame(SOURCES, "path string, content binary")
    got = C.sync_actions(change(spark, CHANGES), src, extensions=("py",))
    assert rows(got, "path", "action") == [("a.py", "reparse"), ("b.py", "delete"), ("d.py", "add"), ("new.py", "add")]
    after = C.apply_actions(src, got)
    assert rows(after.withColumn("t", F.col("content").cast("string")), "path", "t") == [("a.py", "x = 5\n"), ("c.txt", "z"), ("d.py", "y = 2\n"), ("new.py", "n = 1\n")]


def test_inverse_restores(spark):
    src = spark.createDataFrame(SOURCES, "path string, content binary")
    ch = change(spark, [("a.py", "modified", None, "q"), ("b.py", "renamed", "d.py", "y = 2\n"), ("e.py", "added", None, "e"), ("c.txt", "removed", None, None)])
    after = C.apply_actions(src, C.sync_actions(ch, src))
    back = C.apply_actions(after, C.sync_actions(C.inverse_changes(ch, src), after))
    assert rows(back, "path", "content") == rows(src, "path", "content")


def test_stream_replay_equals_rebuild(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    batches = [[("m.py", "added", None, "def f(): pass\n")], [("n.py", "added", None, "from m import f\ndef g(): f()\n")], [("m.py", "modified", None, "def f(): return 1\ndef h(): pass\n"), ("n.py", "renamed", "k.py", "from m import f\ndef g(): f()\n")]]
    for i, b in enumerate(batches):
        spark.createDataFrame([(p, k, to, c.encode(), None, j) for j, (p, k, to, c) in enumerate(b)], C.CHANGES).coalesce(1).write.parquet(str(inbox / f"b{i}"))
    repo = C.Repository(spark, f"file://{tmp_path}/state", "python")
    seen = []
    stream = C.change_stream(spark, f"file://{inbox}/*", "parquet")
    q = repo.follow(stream, f"file://{tmp_path}/ckpt", after=lambda g, v: seen.append(v))
    q.awaitTermination(240)
    assert seen == [1, 2, 3] and repo.versions() == [1, 2, 3] and repo.generation == 3
    g = repo.graph()
    assert rows(g.files, "path") == [("k.py",), ("m.py",)]
    name = {r.id: r.name for r in g.symbols.collect()}
    assert [(name[r.source_symbol_id], name[r.target_symbol_id]) for r in g.references.collect()] == [("g", "f")]
    before = repo.snapshot()
    assert repo.revert(1) == 4 and rows(repo.sources(), "path") == [("m.py",)] and repo.snapshot() != before
    changed = repo.graph(3)
    m = changed.files.where("path = 'm.py'").select(F.col("id").alias("file_id"))
    assert C.affected(changed.references, m, changed.symbols).count() == 2


def test_listing_of_changes(spark):
    lines = spark.createDataFrame([("A\tx.py",), ("R100\told.py\tnew.py",), ("D\tz.py",)], "value string")
    assert rows(C.from_name_status(lines), "path", "change", "rename_to") == [("old.py", "renamed", "new.py"), ("x.py", "added", None), ("z.py", "removed", None)]


def test_event_time_windows_drop_late_rows(spark, tmp_path):
    def put(name, events):
        with open(tmp_path / f"{name}.json", "w") as f:
            for ts, k in events:
                f.write(json.dumps({"ts": ts, "k": k}) + "\n")

    put("a", [("2024-01-01T00:10:00", "x"), ("2024-01-01T00:20:00", "x"), ("2024-01-01T05:00:00", "y")])
    s = spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = C.tumbling(s, "1 hour", ["k"], late="30 minutes").writeStream.format("memory").queryName("tumbled").outputMode("append").start()
    q.processAllAvailable()
    put("b", [("2024-01-01T00:30:00", "x"), ("2024-01-01T09:00:00", "z")])  # the first is too late
    q.processAllAvailable()
    q.stop()
    got = {(r.k, r.n) for r in spark.table("tumbled").collect()}
    assert ("x", 2) in got and ("x", 3) not in got and ("y", 1) in got
    batch = spark.read.schema("ts timestamp, k string").json(str(tmp_path))
    assert rows(C.sessions(batch, "15 minutes", ["k"]), "k", "n") == [("x", 3), ("y", 1), ("z", 1)]
    assert C.sliding(batch, "1 hour", "30 minutes", ["k"]).where("k = 'y'").count() == 2


@pytest.mark.parametrize("folder", ["w"])
def test_watched_files(spark, tmp_path, folder):
    d = tmp_path / folder / "sub"
    d.mkdir(parents=True)
    (d / "a.py").write_text("x")
    q = C.watched_files(spark, f"file://{tmp_path / folder}", "*.py").writeStream.format("memory").queryName("watched").start()
    q.processAllAvailable()
    q.stop()
    assert [r.path for r in spark.table("watched").collect()] == ["sub/a.py"]


def test_affected_files_follow_long_chains(spark):
    symbols = spark.range(70).select("id", F.col("id").alias("file_id"))
    references = spark.range(1, 70).select(F.col("id").alias("source_file_id"), (F.col("id") - 1).alias("target_symbol_id"))
    got = C.affected(references, spark.createDataFrame([(0,)], "file_id long"), symbols)
    assert rows(got, "file_id") == sorted([(i,) for i in range(70)], key=repr)


def test_incremental_graph_equals_a_rebuild(spark, tmp_path):
    repo = C.Repository(spark, f"file://{tmp_path}/state", "python")
    repo.KEPT = 2  # a whole table after every second change
    steps = [
        [("m.py", "added", None, "def f(): pass\n"), ("n.py", "added", None, "from m import f\ndef g(): f()\n"), ("o.py", "added", None, "import n\n")],
        [("m.py", "modified", None, "def f(): return 1\ndef h(): f()\n")],
        [("n.py", "renamed", "k.py", "from m import h\ndef g(): h()\n"), ("o.py", "removed", None, None)],
        [("p.py", "added", None, "from k import g\ng()\n")],
    ]

    def tables(g):
        name = g.symbols.join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", F.concat_ws(":", "path", "name").alias("n"))
        a, b = (name.select(F.col("id").alias(c), F.col("n").alias(x)) for c, x in (("source_symbol_id", "a"), ("target_symbol_id", "b")))
        return rows(name, "n"), rows(g.references.join(a, "source_symbol_id", "left").join(b, "target_symbol_id"), "a", "b"), rows(g.files, "path", "content_hash")

    for step in steps:
        repo.sync(change(spark, step))
        assert tables(repo.graph()) == tables(C.CodeGraph(spark, repo.sources(), "python"))
    assert repo.versions() == [0, 1, 2, 3] and repo._stored("sources")[1] == [1, 3]
    # what is stored of an unchanged file is taken as it is
    extracted = spark.read.parquet(f"{tmp_path}/state/parsed/v=3")
    assert [r.path for r in extracted.collect()] == ["p.py"]
    assert rows(repo.graph(1).files, "path") == [("m.py",), ("n.py",), ("o.py",)]
