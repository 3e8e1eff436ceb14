"""Keeping the tables of a repository current under a stream of file changes, and event-time windows over changes.

A change is a row (path, change, rename_to, content, ts, seq) with change one of added, modified, renamed, removed. The
state is a versioned table of sources, and one of what was extracted from them, in a shared folder; every micro-batch
writes the changed rows as a new version, so a batch that runs again after a failure writes the same version anew and
readers never see half of one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.lineage import cut
from graphloom.operators.joins import last_wins
from graphloom.plans.codegraph import CodeGraph
from graphloom.sources.repo import parse

SOURCES = "path string, content binary"
PARSED = schema.PARSED + ", _gone boolean"
CHANGES = "path string, change string, rename_to string, content binary, ts timestamp, seq bigint"


def sync_actions(changes: DataFrame, present: DataFrame, extensions: tuple[str, ...] | None = None, subdirs: tuple[str, ...] = ()) -> DataFrame:
    """(path, action, content) with action add, reparse or delete: the last change of a path decides.

    A renamed file is a deletion of the old and an addition of the new path. Adding a file that is there is a reparse,
    a modification of one that isn't an addition, and a deletion of one that isn't is left out. Paths outside the
    extensions or directories are left out.
    """
    c = changes.withColumn("_r", F.col("change") == "renamed")
    here = c.select("path", F.when(F.col("change") == "added", "add").when(F.col("change") == "modified", "reparse").otherwise("delete").alias("action"), F.when(~F.col("_r"), F.col("content")).alias("content"), "ts", "seq", F.lit(0).alias("part"))
    there = c.where("_r and rename_to is not null").select(F.col("rename_to").alias("path"), F.lit("add").alias("action"), "content", "ts", "seq", F.lit(1).alias("part"))
    all_ = here.unionAll(there)
    if extensions:
        all_ = all_.where(F.col("path").rlike(rf"\.({'|'.join(e.lstrip('.') for e in extensions)})$"))
    if subdirs:
        keep = F.lit(False)
        for s in subdirs:
            keep |= F.startswith(F.col("path"), F.lit(s.rstrip("/") + "/"))
        all_ = all_.where(keep)
    last = last_wins(all_, ["path"], ["ts", "seq", "part"]).select("path", "action", "content")
    known = present.select(F.col("path").alias("_p")).distinct()
    j = last.join(known, F.col("path") == F.col("_p"), "left")
    there_ = F.col("_p").isNotNull()
    action = F.when(F.col("action") == "delete", F.when(there_, "delete")).otherwise(F.when(there_, "reparse").otherwise("add"))
    return j.select("path", action.alias("action"), "content").where("action is not null")


def apply_actions(sources: DataFrame, actions: DataFrame) -> DataFrame:
    """(path, content) after the actions. Rows of untouched paths are not changed."""
    kept = sources.select("path", "content").join(actions.select("path"), "path", "left_anti")
    return kept.unionByName(actions.where("action <> 'delete'").select("path", F.coalesce("content", F.lit(b"")).alias("content")))


def inverse_changes(changes: DataFrame, before: DataFrame) -> DataFrame:
    """Changes that undo the given ones, in reverse order; contents come from the sources before them."""
    old = before.select(F.col("path").alias("_p"), F.col("content").alias("_c"))
    j = changes.join(old, F.col("path") == F.col("_p"), "left")
    k = F.col("change")
    return j.select(
        F.when(k == "renamed", F.col("rename_to")).otherwise(F.col("path")).alias("path"), F.when(k == "added", "removed").when(k == "removed", "added").otherwise(k).alias("change"),
        F.when(k == "renamed", F.col("path")).alias("rename_to"), F.when(k != "added", F.col("_c")).alias("content"), "ts", (-F.col("seq")).alias("seq"),
    )


def affected(references: DataFrame, changed_files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id) whose resolution may change with the changed files: they, and files that refer to them, to a fixed point."""
    from graphloom.operators.traversal import reach

    at = symbols.select(F.col("id").alias("target_symbol_id"), F.col("file_id").alias("src"))
    e = references.join(at, "target_symbol_id").select("src", F.col("source_file_id").alias("dst")).where("src <> dst").distinct()
    start = changed_files.select(F.col("file_id").alias("node")).distinct()
    return reach(e, start).select(F.col("node").alias("file_id")).unionAll(start.select(F.col("node").alias("file_id"))).distinct()


class Repository:
    """Versions of a repository's sources and of what was extracted from them, in a shared folder.

    A version is stored as the rows that changed (v=N), with a null content for a path that went; every KEPT versions the
    whole table is stored besides (full=N), so a version is read from one whole table and few changes. Files that a
    change doesn't touch are neither written nor parsed again.
    """

    KEPT = 16

    def __init__(self, spark: SparkSession, folder: str, language: str):
        self.spark, self.folder, self.language = spark, folder.rstrip("/"), language

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _stored(self, table: str) -> tuple[list[int], list[int]]:
        """Complete changes and whole tables, ascending: those whose folder has Spark's success mark."""
        fs, path = self._fs()
        root = path(f"{self.folder}/{table}")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        done = [n for n in names if fs.exists(path(f"{self.folder}/{table}/{n}/_SUCCESS"))]
        return tuple(sorted(int(n.split("=")[1]) for n in done if n.startswith(kind)) for kind in ("v=", "full="))

    def versions(self) -> list[int]:
        """Complete versions, ascending."""
        changed, whole = self._stored("sources")
        return sorted({*changed, *whole})

    @property
    def generation(self) -> int:
        return max(self.versions(), default=-1)

    def _read(self, table: str, version: int, ddl: str) -> DataFrame:
        changed, whole = self._stored(table)
        base = max((v for v in whole if v <= version), default=-1)
        read = lambda kind, v: self.spark.read.schema(ddl).parquet(f"{self.folder}/{table}/{kind}={v}")
        out = read("full", base) if base >= 0 else self.spark.createDataFrame([], ddl)
        later = [v for v in changed if base < v <= version]
        if not later:
            return out
        new = None
        for v in later:
            x = read("v", v).withColumn("_v", F.lit(v))
            new = x if new is None else new.unionAll(x)
        last = new.groupBy("path").agg(F.max("_v").alias("_last")).withColumnRenamed("path", "_p")
        new = new.join(last, (F.col("path") == F.col("_p")) & (F.col("_v") == F.col("_last"))).drop("_p", "_v", "_last")
        return out.join(last.select(F.col("_p").alias("path")), "path", "left_anti").unionByName(new)

    def _write(self, table: str, rows: DataFrame, version: int, ddl: str, whole: bool) -> None:
        kind = "full" if whole else "v"
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/{kind}={version}")
        changed, full = self._stored(table)
        base = max((v for v in full if v <= version), default=-1)
        if not whole and sum(base < v <= version for v in changed) >= self.KEPT:
            self._read(table, version, ddl).write.mode("overwrite").parquet(f"{self.folder}/{table}/full={version}")

    def sources(self, version: int | None = None) -> DataFrame:
        v = self.generation if version is None else version
        return self._read("sources", v, SOURCES).where("content is not null")

    def parsed(self, version: int | None = None) -> DataFrame:
        """What was extracted from the files of a version."""
        v = self.generation if version is None else version
        return self._read("parsed", v, PARSED).where("not _gone").drop("_gone")

    def write(self, sources: DataFrame, version: int) -> int:
        """A version of these sources, whatever was there before."""
        s = sources.select("path", F.col("content").cast("binary").alias("content")).where("content is not null")
        self._write("parsed", parse(s, self.language).withColumn("_gone", F.lit(False)), version, PARSED, True)
        self._write("sources", s, version, SOURCES, True)
        return version

    def sync(self, changes: DataFrame, version: int | None = None, **filters) -> int:
        """The version after the changes; its number may be given, so that a repeated batch gives no second one."""
        base = max((v for v in self.versions() if version is None or v < version), default=-1)
        version = base + 1 if version is None else version
        actions = cut(sync_actions(changes, self.sources(base), **filters))
        there = F.col("action") != "delete"
        own = actions.select("path", F.when(there, F.coalesce("content", F.lit(b""))).alias("content"))
        new = parse(own.where("content is not null"), self.language).withColumn("_gone", F.lit(False))
        gone = actions.where(~there).select("path", F.lit(True).alias("_gone"))
        self._write("parsed", new.unionByName(gone, allowMissingColumns=True), version, PARSED, False)
        self._write("sources", own, version, SOURCES, False)  # last: a version counts once its sources are there
        return version

    def revert(self, version: int) -> int:
        """A new version with the sources of an old one."""
        new = self.generation + 1
        self._write("parsed", self.parsed(version).withColumn("_gone", F.lit(False)), new, PARSED, True)
        self._write("sources", self.sources(version), new, SOURCES, True)
        return new

    def graph(self, version: int | None = None) -> CodeGraph:
        """The graph of a version, from what is stored of its files' extraction."""
        return CodeGraph(self.spark, self.sources(version), self.language, extracted=self.parsed(version))

    def snapshot(self) -> str:
        """A digest of version, paths and contents; it differs if anything does."""
        s = self.sources()
        one = s.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "content").cast("decimal(38,0)")).alias("h")).first()
        return json.dumps({"generation": self.generation, "files": one.n, "hash": str(one.h)}, sort_keys=True)

    def follow(self, stream: DataFrame, checkpoint: str, after: Callable[[CodeGraph, int], None] | None = None, available_now: bool = True, **filters):
        """A streaming query that syncs every micro-batch of changes; after is called with each version's graph.

        The version of batch b is b + 1 (0 is what was there before), so a batch that is repeated overwrites its own.
        """

        def one(batch: DataFrame, batch_id: int) -> None:
            v = self.sync(batch, version=batch_id + 1, **filters)
            if after is not None:
                after(self.graph(v), v)

        writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def change_stream(spark: SparkSession, folder: str, fmt: str = "json", max_files: int = 1) -> DataFrame:
    """Changes from files that arrive in a folder."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", max_files).format(fmt).load(folder)


def watched_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """New files of a folder as a stream of changes (each an addition, which the sync turns into a reparse)."""
    f = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    bare = folder.rstrip("/").split("://")[-1].lstrip("/")
    path = F.regexp_replace("path", f"^[a-z0-9+.-]+:/*{bare}/", "")
    return f.select(path.alias("path"), F.lit("added").alias("change"), F.lit(None).cast("string").alias("rename_to"), "content", F.col("modificationTime").alias("ts"), F.lit(0).cast("long").alias("seq"))


def from_name_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, change, rename_to) of the lines of a version control system's name-status listing."""
    p = F.split(column, "\t")
    kind = F.substring(p[0], 1, 1)
    change = F.when(kind == "A", "added").when(kind == "M", "modified").when(kind == "D", "removed").when(kind == "R", "renamed")
    return lines.select(p[1].alias("path"), change.alias("change"), F.when(kind == "R", F.get(p, F.lit(2))).alias("rename_to")).where("change is not null")


# event time -----------------------------------------------------------------------------------------------------------


def tumbling(stream: DataFrame, size: str, keys: list[str], late: str = "1 hour", at: str = "ts", **sums: str) -> DataFrame:
    """(start, keys, n, sums): rows per window and key, and sums of the columns named. On a stream, rows later than `late` are dropped once it has passed."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])
    return w.select(F.col("window.start").alias("start"), *keys, "n", *sums)


def sliding(stream: DataFrame, size: str, step: str, keys: list[str], late: str = "1 hour", at: str = "ts") -> DataFrame:
    """As tumbling, with windows that overlap."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, size, step), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, gap: str, keys: list[str], late: str = "1 hour", at: str = "ts") -> DataFrame:
    """(start, end, keys, n): runs of rows of a key without a pause as long as the gap."""
    w = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def latest_per_path(stream: DataFrame) -> DataFrame:
    """The last change of each path so far, as an updating aggregate; its state grows with the paths, not the changes."""
    return stream.groupBy("path").agg(F.max_by(F.struct("change", "rename_to", "ts"), F.struct("ts", "seq")).alias("last")).select("path", "last.*")


__all__ = ["CHANGES", "Repository", "affected", "apply_actions", "change_stream", "from_name_status", "inverse_changes", "latest_per_path", "sessions", "sliding", "sync_actions", "tumbling", "watched_files"]
