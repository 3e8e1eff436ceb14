"""WARC archives: a writer that replaces repeated payloads by revisit records, and a salvage reader.

The reader checks each record (gzip member, version line, header, block length, end mark, digests). After a failed
check it searches the bytes, those that a gzip member inflates to or else the file's, for the next version line or member
at which a whole record passes all checks, goes on from there, and returns the bytes between as a quarantined gap. A
member's records are given as it inflates, so those before a damaged place are kept, and those after a damaged record of
a whole member too. Files are read through windows, so the size of an archive or of a member doesn't matter; a single
record must fit in memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, fresh_path, tune

#: A writer begins a new archive beyond so many bytes.
ARCHIVE_BYTES = 64 << 20
WINDOW = 1 << 20
VERSION = b"WARC/1."
VERSION_LINE = re.compile(rb"WARC/1\.\d\r\n")
#: Fields that a header has once; a second one is that of another record.
SINGLE = {"warc-type", "warc-record-id", "warc-date", "content-length"}
MEMBER = b"\x1f\x8b\x08"
#: Bytes in which a header's end is looked for first; longer headers are read on in growing windows.
HEADER_FIRST = 1 << 16
#: Deflate makes at most so many bytes of one.
RATIO = 1032
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: offset and length: bytes of the file, for records of a gzip member those of the member, and place is then where the
#: record or gap begins among the bytes that the member inflates to (size: how many of them; null where they end with it).
RECORD_SCHEMA = (
    "archive string, offset long, length long, place long, size long, status string, reason string, record_id string, record_type string, "
    "target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def digest_of(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _decoded(value: str, size: int) -> bytes | None:
    """The bytes of a digest of `size` bytes, written in hexadecimal, base32 or base64; None if it is none of them."""
    bare = value.rstrip("=")
    try:
        if len(bare) == 2 * size:
            return bytes.fromhex(bare)
        if len(bare) == -(-8 * size // 5):
            return base64.b32decode(bare.upper() + "=" * (-len(bare) % 8))
        if len(bare) == -(-4 * size // 3):
            return base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4), validate=True)
    except ValueError:
        pass
    return None


def same_digest(said: str | None, data: bytes) -> bool:
    """Whether a digest field (algorithm:value, SHA-1 where no algorithm is named) is that of the data.

    Absent fields and those of an algorithm that this machine doesn't know say nothing, which passes.
    """
    algorithm, colon, value = (said or "").strip().partition(":")
    if not colon:
        algorithm, value = "sha1", algorithm
    algorithm = algorithm.lower().replace("-", "")
    if not value or algorithm not in hashlib.algorithms_available or algorithm.startswith("shake"):
        return True
    own = hashlib.new(algorithm, data).digest()
    return _decoded(value, len(own)) == own


def bare_digest(said: str) -> str:
    """A SHA-1 field as bare upper-case base32; other fields as they are."""
    algorithm, colon, value = said.partition(":")
    found = _decoded(value if colon else algorithm, 20) if algorithm.lower() in ("sha1", "sha-1") or not colon else None
    return base64.b32encode(found).decode() if found else said


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(record_id: str, uri: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record: a response with the payload, or a revisit of refers_to without it."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(uri) if uri else 'urn:unknown'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member_bytes(record: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def write_archives(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    folder: str | None = None,
    least_bytes: int = 0,
    compress: bool = True,
) -> DataFrame:
    """Write one record per row into archives of a shared folder; returns rows (archive, records, bytes).

    Of rows with equal payloads of at least least_bytes bytes, that with the largest id is a response and the others
    revisit it (repeated rows of the largest id are responses too); smaller payloads are all responses. A null payload
    is empty, a null id counts as the least and is written as none, a null url as urn:unknown. The returned table is
    written before the call ends: archives of failed tasks are in no row of it. Other columns are not read.
    """
    spark = df.sparkSession
    tune(spark)
    folder = folder or fresh_path(spark, "warc")
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    # the narrow pass: the largest id of each payload, combined before it is shuffled
    tops = cut(rows.groupBy(F.col("digest").alias("d")).agg(F.max("id").alias("top")))
    rows = rows.join(tops, rows.digest == tops.d, "left").select("id", "url", "payload", "top")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        sink, name, count, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for key, url, payload, top in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if sink is not None and size >= ARCHIVE_BYTES:
                    sink.close()
                    done.append((name, count, size))
                    sink = None
                if sink is None:
                    name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * compress
                    sink, count, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = payload.encode("utf-8", "surrogatepass")
                again = len(data) >= least_bytes and key != top and top is not None
                record = record_bytes(f"urn:page:{'none' if key is None else key}", url, data, f"urn:page:{top}" if again else None)
                record = member_bytes(record) if compress else record
                sink.write(record)
                count, size = count + 1, size + len(record)
        if sink is not None:
            sink.close()
            done.append((name, count, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{n}" for n, _, _ in done], pa.string()), pa.array([c for _, c, _ in done], pa.int64()), pa.array([s for _, _, s in done], pa.int64())],
            names=["archive", "records", "bytes"],
        )

    return cut(rows.mapInArrow(run, schema="archive string, records long, bytes long"))


class Bad(Exception):
    """A record that fails a check."""


class Window:
    """Random reads of a file, a window at a time."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.held = source, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.source.seek(at)
            self.at, self.held = at, self.source.read(max(n, min(WINDOW, self.size - at)))
        return self.held[at - self.at : at - self.at + n]

    def find(self, marks: tuple[bytes, ...], at: int) -> int:
        """The next place of any mark, or the file's end."""
        most = max(map(len, marks))
        while at < self.size:
            piece = self.read(at, WINDOW)
            found = [p for p in (piece.find(m) for m in marks) if p >= 0]
            if found:
                return at + min(found)
            if at + len(piece) >= self.size:
                break
            at += len(piece) - most + 1
        return self.size


def _parse(read, at: int, end: int | None) -> tuple[dict, int]:
    """The record at `at` of what read(at, n) gives, and where it ends. Raises Bad."""
    head, asked = read(at, HEADER_FIRST), HEADER_FIRST
    if not VERSION_LINE.match(head):
        raise Bad("no version line")
    stop = head.find(b"\r\n\r\n")
    while stop < 0:
        if len(head) < asked:  # the file or member ends here
            raise Bad("header without end")
        seen, asked = len(head), 2 * asked
        head = read(at, asked)
        stop = head.find(b"\r\n\r\n", seen - 3)
    fields: dict[str, str] = {}
    for line in head[:stop].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise Bad("header line without colon")
        name = k.decode("latin-1").strip().lower()
        if name in fields and name in SINGLE:
            raise Bad("header repeats a field")
        fields[name] = v.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
        raise Bad("no content length")
    n = int(fields["content-length"])
    if end is not None and at + stop + 4 + n > end:
        raise Bad("block is cut off")
    block = read(at + stop + 4, n)
    if len(block) < n:
        raise Bad("block is cut off")
    if read(at + stop + 4 + n, 4) != b"\r\n\r\n":
        raise Bad("no end mark after the block")
    kind = fields.get("warc-type", "")
    if not same_digest(fields.get("warc-block-digest"), block):
        raise Bad("block digest differs")
    payload, payload_bytes = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, mark, payload = block.partition(b"\r\n\r\n")
        if not mark:
            raise Bad("HTTP header without end")
        said = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http.replace(b"\r\n", b"\n"))
        payload_bytes = int(said[1]) if said else len(payload)
    want = fields.get("warc-payload-digest", "")
    if kind != "revisit":
        payload_bytes = len(payload)
        if not same_digest(want, payload):
            raise Bad("payload digest differs")
        want = digest_of(payload)
    else:
        want = bare_digest(want)
    bare = lambda x: x.strip("<>") if x else None
    return {
        "record_id": bare(fields.get("warc-record-id")),
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": bare(fields.get("warc-refers-to")),
        "payload_digest": want or digest_of(payload),
        "payload_bytes": payload_bytes,
        "payload": None if kind == "revisit" else payload,
    }, at + stop + 4 + n + 4


def _up_to_damage(inflater, piece: bytes) -> bytes:
    """What a piece gives before the place at which it fails."""
    out, at = bytearray(), 0
    for step in (4096, 64, 1):
        while at < len(piece):
            before = inflater.copy()
            try:
                out += inflater.decompress(piece[at : at + step])
            except zlib.error:
                inflater = before
                break
            at += step
    return bytes(out)


class Inflated:
    """Reads of what a gzip member inflates to; bytes before the last place asked for may be gone."""

    def __init__(self, window: Window, at: int):
        self.window, self.pos, self.at, self.held = window, at, 0, bytearray()
        self.inflater = zlib.decompressobj(31)
        self.broken: str | None = None

    def read(self, at: int, n: int) -> bytes:
        while len(self.held) < at + n - self.at and not self.inflater.eof and not self.broken:
            piece = self.window.read(self.pos, WINDOW >> 2 if self.held else WINDOW >> 5)
            if not piece:
                self.broken = "gzip member is cut off"
                break
            before = self.inflater.copy()
            try:
                self.held += self.inflater.decompress(piece)
            except zlib.error as e:
                self.broken = f"gzip: {e}"
                self.held += _up_to_damage(before, piece)
            self.pos += len(piece)
        return bytes(self.held[at - self.at : at - self.at + n])

    def forget(self, before: int) -> None:
        del self.held[: before - self.at]
        self.at = before

    def find(self, at: int) -> int | None:
        """The next version line's place, or None."""
        while True:
            piece = self.read(at, WINDOW)
            p = piece.find(VERSION)
            if p >= 0:
                return at + p
            if len(piece) < WINDOW:
                return None
            at += len(piece) - len(VERSION) + 1
            self.forget(at)

    @property
    def end(self) -> int:
        """Where the member ends in the file."""
        return self.pos - len(self.inflater.unused_data)

    @property
    def most(self) -> int:
        """A bound of the inflated bytes."""
        return self.at + len(self.held) + (0 if self.inflater.eof else RATIO * (self.window.size - self.pos))


def _member(window: Window, at: int) -> Iterator[dict]:
    """Records and gaps of the gzip member at `at`, in places of its inflated bytes; the last row may be a gap that ends with the bytes."""
    member, p = Inflated(window, at), 0
    while member.read(p, 1):
        q, reason = p, None
        while True:
            try:
                member.read(q, HEADER_FIRST)
                record, end = _parse(member.read, q, member.most)
                break
            except Bad as e:
                reason = reason or str(e)
                q = member.find(q + 1)
                if q is None:
                    whole = {} if member.broken else {"size": member.at + len(member.held) - p}
                    yield {"place": p, "status": "quarantined", "reason": member.broken or reason} | whole
                    if whole:
                        yield {"end": member.end}
                    return
        if reason:
            yield {"place": p, "size": q - p, "status": "quarantined", "reason": reason}
        yield record | {"place": q, "size": end - q, "status": "ok"}
        member.forget(end)
        p = end
    if member.broken or not p:
        yield {"place": p, "status": "quarantined", "reason": member.broken or "empty gzip member"}
        return
    yield {"end": member.end}


def salvage(source, size: int) -> Iterator[dict]:
    """Records and quarantined gaps of one archive, in the order of their offsets.

    Records of a gzip member have the member's offset, and its length unless the member is damaged. A member with a
    damaged end is quarantined from the last place of its inflated bytes that passed the checks; the bytes of the file
    are then searched for the next member or version line.
    """
    window = Window(source, size)
    pos = 0
    while pos < size:
        start, reason, place = pos, None, None
        if window.read(pos, 3) == MEMBER:
            rows, end = [], None
            held = 0
            for r in _member(window, pos):
                if "end" in r:
                    end = r["end"]
                elif r["status"] == "ok" or "size" in r:
                    rows.append(r)
                    held += len(r.get("payload") or b"")
                else:
                    reason, place = r["reason"], r["place"]
                if held > 8 << 20:  # a member of many records: its end isn't known yet
                    yield from (x | {"offset": pos} for x in rows)
                    rows, held = [], 0
            length = {"length": end - pos} if end is not None else {}
            yield from (x | {"offset": pos} | length for x in rows)
            if end is not None:
                pos = end
                continue
        else:
            try:
                record, end = _parse(window.read, pos, size)
                yield record | {"offset": pos, "length": end - pos, "status": "ok"}
                pos = end
                continue
            except Bad as e:
                reason = str(e)
        while pos < size:  # on to the next place at which a record passes all checks
            pos = window.find((MEMBER, VERSION), pos + 1)
            if pos >= size:
                break
            if window.read(pos, 3) == MEMBER:
                if any(r.get("status") == "ok" for r in _member(window, pos)):
                    break
                continue
            try:
                _parse(window.read, pos, size)
                break
            except Bad:
                continue
        pos = min(pos, size)
        yield {"offset": start, "length": pos - start, "place": place, "status": "quarantined", "reason": reason}


def read_archives(archives: DataFrame, path_col: str = "archive") -> DataFrame:
    """All records and gaps of the archives in rows of RECORD_SCHEMA.

    A gap has status quarantined, its offset, length and the failed check, and null in the record's columns; one within a
    gzip member has its place among the inflated bytes besides. Length is null for records of a member that is damaged or
    of so many bytes that they are given before its end is known. Null paths
    are skipped, an empty archive gives no row, a path named twice is read twice.
    """
    spark = archives.sparkSession
    tune(spark)
    names = [x.strip().split(" ")[0] for x in RECORD_SCHEMA.split(",")]
    types = {"offset": pa.int64(), "length": pa.int64(), "place": pa.int64(), "size": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in names], names=names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                if uri is None:
                    continue
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as source:
                    rows, held = [], 0
                    for r in salvage(source, source.size()):
                        rows.append(r | {"archive": uri})
                        held += len(r.get("payload") or b"")
                        if len(rows) >= 512 or held > 8 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                    if rows:
                        yield pack(rows)

    paths = archives.select(F.col(path_col).alias("path"))
    parts = max(1, min(100_000, paths.count()))
    return paths.repartition(parts).mapInArrow(run, schema=RECORD_SCHEMA)


def page_id_of(column: str):
    """The page id in a record id, null where it holds none."""
    return F.regexp_extract(column, r"^urn:page:(-?\d+)$", 1).try_cast("long")


__all__ = ["SparkSession", "digest_of", "page_id_of", "read_archives", "record_bytes", "salvage", "write_archives"]
