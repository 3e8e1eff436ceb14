"""Planned edits of files: a table of byte-range changes, the rules for conflicts, and their application per file.

An edit is a row (path, kind, start_byte, end_byte, text, priority, seq). Kinds and their order at one place:

    remove, remove_lines   delete the bytes; remove_lines takes the whole line with it if nothing else stands there
    edit                   replace the bytes by text
    insert                 put text before start_byte
    file_add               a new file with the text
    file_rename            the file's path becomes the text
    file_remove            the file goes

seq orders the edits of a file as they were asked for. An edit inside a removed range is dropped; a removal drops what it
covers; a replacement that meets others is broken down into inserts around the old text if it contains it, else the file
is left alone and the conflict reported.
"""

from __future__ import annotations

import difflib
import re
import time
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.rows import common

ORDER = ("remove", "edit", "insert", "file_add", "file_rename", "file_remove")
SCHEMA = "path string, kind string, start_byte bigint, end_byte bigint, text string, priority bigint, seq bigint"


class Conflict(Exception):
    """Two edits of a file that can't both be made."""


@dataclass(frozen=True)
class Edit:
    kind: str
    start: int
    end: int
    text: str = ""
    priority: int = 0
    seq: int = 0

    def what(self) -> tuple:
        """Equal for two edits that do the same, whenever they were asked for."""
        return self.kind, self.start, self.end, self.text, self.priority

    def meets(self, other: Edit) -> bool:
        return self.start < other.end and self.end > other.start

    def sort_key(self) -> tuple:
        return -self.start, ORDER.index(self.kind), self.priority, -self.seq


def around(edit: Edit, data: bytes) -> list[Edit] | None:
    """The inserts that do what a replacement does whose text contains the old one."""
    old, new = data[edit.start : edit.end], edit.text.encode()
    at = new.find(old) if old else -1
    if at < 0:
        return None
    parts = [("insert", edit.start, new[:at]), ("insert", edit.end, new[at + len(old) :])]
    return [Edit(k, p, p, t.decode(), edit.priority, edit.seq) for k, p, t in parts if t]


def whole_lines(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The range with an export word before it and, if nothing else stands on its lines, their blanks and line end."""
    begin = data.rfind(b"\n", 0, start) + 1
    word = re.search(rb"export\s+(?:default\s+)?$", data[begin:start])
    if word:
        start = begin + word.start()
    stop = data.find(b"\n", end)
    stop = len(data) if stop < 0 else stop + 1
    if data[begin:start].strip() or data[end:stop].strip(b" \t\r\n;"):
        return start, end
    return begin, stop


def together(edits: list[Edit]) -> list[int]:
    """The number of each edit's group; edits of different groups never meet, nor do the parts they are broken into."""
    spans = [(min(e.start, e.end), max(e.start, e.end)) for e in edits]
    group, n, stop = [0] * len(edits), -1, None
    for i in sorted(range(len(edits)), key=spans.__getitem__):
        start, end = spans[i]
        if stop is None or start >= stop:
            n, stop = n + 1, end
        group[i], stop = n, max(stop, end)
    return group


def settle(data: bytes, edits: list[Edit]) -> list[Edit]:
    """The edits that remain after conflicts, in the order of their execution.

    An edit is held against those of its own group only, so work grows with the edits, not with their square.
    """
    queued = []
    for e in sorted(edits, key=lambda x: x.seq):
        if e.kind == "remove_lines":
            a, b = whole_lines(data, e.start, e.end)
            e = Edit("remove", a, b, "", e.priority, e.seq)
        queued.append(e)
    groups: defaultdict[int, list[tuple[Edit, int]]] = defaultdict(list)
    held: Counter[tuple] = Counter()
    place = count()

    def keep(e: Edit, kept: list[tuple[Edit, int]]) -> None:
        kept.append((e, next(place)))
        held[e.what()] += 1

    def drop(e: Edit, kept: list[tuple[Edit, int]]) -> None:
        del kept[next(i for i, (k, _) in enumerate(kept) if k == e)]
        held[e.what()] -= 1

    def admit(e: Edit, kept: list[tuple[Edit, int]]) -> None:
        met = [k for k, _ in kept if e.meets(k)]
        cover = next((k for k in met if k.start <= e.start and e.end <= k.end), None)
        if cover is not None:
            if cover.kind == "remove":
                return
            parts = around(cover, data)
            if parts is None:
                raise Conflict(f"{e.kind} at {e.start}-{e.end} lies within an edit of {cover.start}-{cover.end}")
            drop(cover, kept)
            for p in parts:
                admit(p, kept)
        elif met and e.kind == "remove":
            for k in met:
                drop(k, kept)
        elif met and e.kind == "edit":
            parts = around(e, data)
            if parts is None:
                raise Conflict(f"edit of {e.start}-{e.end} overlaps {len(met)} other edits")
            for p in parts:
                admit(p, kept)
            return
        keep(e, kept)

    for e, group in zip(queued, together(queued)):
        if not held[e.what()]:
            admit(e, groups[group])
    return [e for e, _ in sorted((x for kept in groups.values() for x in kept), key=lambda x: (*x[0].sort_key(), x[1]))]


def splice(data: bytes, edits: list[Edit]) -> bytes:
    """The bytes after all edits, made from the back to the front; what lies between edits is copied once."""
    parts, limit = [], len(data)  # data up to limit, then the parts from the last to the first, is the text so far
    for e in settle(data, edits):
        if not 0 <= e.start <= e.end <= limit:
            data = data[:limit] + b"".join(reversed(parts))
            data = data[: e.start] + e.text.encode() + data[e.end :]
            parts, limit = [], len(data)
            continue
        parts += [data[e.end : limit], e.text.encode()]
        limit = e.start
    return data[:limit] + b"".join(reversed(parts))


def planned(df: DataFrame, path: Column | str, kind: str, start: Column | str, end: Column | str, text: Column | str = "", priority: int = 0, seq: Column | int = 0) -> DataFrame:
    """Rows of SCHEMA; text may be a column or a fixed string."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    body = F.lit(text) if isinstance(text, str) else text
    order = seq if isinstance(seq, Column) else F.lit(seq)
    return df.select(col(path).alias("path"), F.lit(kind).alias("kind"), col(start).cast("long").alias("start_byte"), col(end).cast("long").alias("end_byte"), body.alias("text"), F.lit(priority).cast("long").alias("priority"), order.cast("long").alias("seq"))


def listed(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Edits given as (path, kind, start, end, text) in the order asked for."""
    return spark.createDataFrame([(*r, 0, i) for i, r in enumerate(rows)], SCHEMA)


class Limit(Exception):
    """A session asked for more edits, or took longer, than it may."""


class Session:
    """Edits gathered over several plans, within a number of edits and a time."""

    def __init__(self, most: int | None = None, seconds: float | None = None):
        self.most, self.seconds, self.began, self.plans = most, seconds, time.monotonic(), []

    def add(self, edits: DataFrame) -> None:
        if self.seconds is not None and time.monotonic() - self.began > self.seconds:
            raise Limit(f"the session took more than {self.seconds} seconds")
        if self.most is not None:
            n = sum(p.limit(self.most + 1).count() for p in [*self.plans, edits])
            if n > self.most:
                raise Limit(f"more than {self.most} edits")
        self.plans.append(edits)

    def commit(self, sources: DataFrame, only: DataFrame | None = None) -> DataFrame:
        """apply() of all plans in their order, or of their edits of some paths; the session is empty then."""
        queued = None
        for i, p in enumerate(self.plans):
            p = p.withColumn("seq", F.col("seq") + (i << 32))
            queued = p if queued is None else queued.unionAll(p)
        self.plans = []
        if queued is None:
            queued = listed(sources.sparkSession, [])
        if only is not None:
            queued = queued.join(common(only.select("path"), queued.select("path")), "path", "left_semi").select(*queued.columns)
        return apply(sources, queued)


def apply(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, old_path, status, conflict) of all files after the edits; sources is (path, content).

    status is unchanged, modified, renamed, added or removed (content null). Edits of files that are not there are
    ignored but for file_add. Only edited files pass through Python; of file operations the last per path counts.
    """
    spans = edits.where(F.col("kind").isin("remove", "remove_lines", "edit", "insert"))
    grouped = spans.groupBy("path").agg(F.collect_list(F.struct("kind", "start_byte", "end_byte", "text", "priority", "seq")).alias("edits"))
    ops = edits.where(F.col("kind").startswith("file_")).groupBy("path").agg(F.max_by(F.struct("kind", "text"), F.struct("seq", "kind")).alias("op"))
    base = sources.select("path", F.col("content").cast("binary").alias("content"))
    touched = base.join(grouped, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, conflict = [], []
            for data, rows in zip(batch.column(1), batch.column(2)):  # objects of one file's edits at a time
                data, fields = data.as_py(), [x.to_pylist() for x in rows.values.flatten()]
                try:
                    content.append(splice(data or b"", [Edit(kind, start, end, text or "", priority, seq) for kind, start, end, text, priority, seq in zip(*fields)]))
                    conflict.append(None)
                except Conflict as e:
                    content.append(data)
                    conflict.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), pa.array(conflict, pa.string())], names=["path", "content", "conflict"])

    changed = touched.mapInArrow(run, schema="path string, content binary, conflict string").withColumn("spliced", F.lit(True))
    same = base.join(grouped, "path", "left_anti").select("path", "content", F.lit(None).cast("string").alias("conflict"), F.lit(False).alias("spliced"))
    files = changed.unionAll(same).join(ops.withColumnRenamed("op", "o"), "path", "left")
    kind = F.coalesce(F.col("o.kind"), F.lit(""))
    status = F.when(kind == "file_remove", "removed").when(kind == "file_rename", "renamed").when(F.col("spliced") & F.col("conflict").isNull(), "modified").otherwise("unchanged")
    after = files.select(
        F.when(kind == "file_rename", F.col("o.text")).otherwise(F.col("path")).alias("path"), F.when(kind != "file_remove", F.col("content")).alias("content"),
        F.when(kind == "file_rename", F.col("path")).alias("old_path"), status.alias("status"), "conflict",
    )
    fresh = ops.where("op.kind = 'file_add'").join(base.select("path"), "path", "left_anti")
    new = fresh.select("path", F.encode(F.coalesce("op.text", F.lit("")), "UTF-8").alias("content"), F.lit(None).cast("string").alias("old_path"), F.lit("added").alias("status"), F.lit(None).cast("string").alias("conflict"))
    extra = new.join(grouped, "path")  # edits of a file that is added in the same go
    plain = new.join(grouped, "path", "left_anti")
    filled = extra.select("path", "content", "edits").mapInArrow(run, schema="path string, content binary, conflict string")
    return after.unionByName(plain).unionByName(filled.select("path", "content", F.lit(None).cast("string").alias("old_path"), F.lit("added").alias("status"), "conflict"))


def diffs(sources: DataFrame, result: DataFrame, context: int = 3) -> DataFrame:
    """(path, status, diff) of changed files, as unified diffs: the preview of a run."""
    old = sources.select(F.col("path").alias("_old"), F.col("content").cast("binary").alias("before"))
    changed = result.where("status <> 'unchanged'")
    pair = changed.join(old, F.coalesce("old_path", "path") == F.col("_old"), "left").select("path", "status", F.coalesce("_old", F.lit("/dev/null")).alias("_old"), "before", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, b = ((r[k] or b"").decode("utf-8", "replace").splitlines(True) for k in ("before", "content"))
                out.append("".join(difflib.unified_diff(a, b, r["_old"], r["path"], n=context)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["path", "status", "diff"])

    return pair.mapInArrow(run, schema="path string, status string, diff string")


def inverse(result: DataFrame, sources: DataFrame) -> DataFrame:
    """File operations and contents that undo a result: (path, content, old_path, status) with content null to remove."""
    old = sources.select(F.col("path").alias("_p"), F.col("content").cast("binary").alias("before"))
    r = result.where("status <> 'unchanged'").join(old, F.coalesce("old_path", "path") == F.col("_p"), "left")
    back = F.when(F.col("status") == "added", "removed").when(F.col("status") == "removed", "added").otherwise(F.col("status"))
    return r.select(F.coalesce("old_path", "path").alias("path"), F.when(F.col("status") != "added", F.col("before")).alias("content"), F.when(F.col("status") == "renamed", F.col("path")).alias("old_path"), back.alias("status"))


def write_files(result: DataFrame, root: str) -> DataFrame:
    """Write changed files below a folder that all executors share; returns (path, status) of what was written.

    Each file is written aside and then moved into place, so a task that runs twice does no harm.
    """
    import pyarrow.fs as pafs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for r in batch.to_pylist():
                path = f"{base}/{r['path']}"
                gone = [f"{base}/{r['old_path']}"] if r["old_path"] else []
                if r["status"] == "removed":
                    gone.append(path)
                else:
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    with fs.open_output_stream(path + ".part") as out:
                        out.write(r["content"] or b"")
                    fs.move(path + ".part", path)
                for p in gone:
                    if fs.get_file_info(p).type != pafs.FileType.NotFound:
                        fs.delete_file(p)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in ("path", "status")], names=["path", "status"])

    return result.where("status <> 'unchanged' and conflict is null").mapInArrow(run, schema="path string, status string")
