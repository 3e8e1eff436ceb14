"""Near-duplicate documents by 64-bit SimHash and multi-index hashing.

A fingerprint is cut into three segments. If two fingerprints differ in at most four bits, then one of the first two
segments differs in at most one bit or the third is equal, since otherwise at least 2 + 2 + 1 bits differ. Every distinct
fingerprint is filed under its three segment values, and it probes the values of its small Hamming balls: for a radius of
one, flips of set bits are enough, as one of two values that differ in a single bit lacks it. Whole distances are then
verified among the entries that met under one value.

Exact copies share a fingerprint, so each fingerprint is searched once. A value under which many fingerprints meet (a
large group of near copies) is filed anew under its value and that of one of five parts of the other bits, at least one
of which is equal in a linked pair; this repeats until groups are small or so few bits are free that a group is bounded.
Within a group links that span its components are returned, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import beside, components, cut, tune

SEED = 42
#: Offsets and widths of the segments, and the radius searched in each.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
LINK_BITS = 4
#: Entries of a group that one task compares; larger groups are filed anew.
GROUP_ROWS = 4096


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; null or no word: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases A-Z and splits at ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    hashes = np.fromiter(
        [digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[width - 1 :].tolist())], dtype="<u8", count=n
    )
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        bits = np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """Rows (id_col, fp long), one per row of df. No shuffle; whole texts."""
    tune(df.sparkSession)
    key = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["_id", "fp"])

    named = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = named.mapInArrow(run, schema=f"_id {key.simpleString()}, fp long")
    return out.select(F.col("_id").alias(id_col), *beside(id_col, "fp"))


def ball_entries(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group key, role (0 filed, 1 probing) and row number of every entry of the fingerprints (uint64)."""
    keys, roles, rows = [], [], []
    every = np.arange(len(fps))
    for s, (at, width, radius) in enumerate(SEGMENTS):
        value = (fps >> np.uint64(at)) & np.uint64((1 << width) - 1)
        tag = np.uint64(s << 32)
        keys.append(value | tag)
        roles.append(np.zeros(len(fps), dtype=np.int8))
        rows.append(every)
        for bit in range(width if radius else 0):
            has = np.flatnonzero(value >> np.uint64(bit) & np.uint64(1))
            keys.append(value[has] ^ np.uint64(1 << bit) | tag)
            roles.append(np.ones(len(has), dtype=np.int8))
            rows.append(has)
    return np.concatenate(keys), np.concatenate(roles), np.concatenate(rows)


def spanning_links(points: np.ndarray, limit: int = LINK_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each component of the points (distinct, uint64) under distance <= limit, one fewer than points."""
    left, right = [], []
    rest = np.sort(points)
    while len(rest):
        root, rest = rest[0], rest[1:]
        edge = [root]
        while edge and len(rest):
            p = edge.pop()
            near = np.bitwise_count(rest ^ p) <= limit
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), root))
                right.append(found)
                edge.extend(found)
                rest = rest[~near]
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _links_of(keys: np.ndarray, roles: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links found in whole groups of one key, given in the order of (key, role)."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, len(keys)))
    filed = np.add.reduceat((roles == 0).astype(np.int64), first)
    lefts, rights = [], []
    small = (filed > 0) & (size > 1) & (filed <= 16)
    at, n, filed_n = first[small], size[small], filed[small]
    for i in range(int(filed_n.max(initial=0))):  # the i-th filed entry of each group against all of its entries
        has = filed_n > i
        a, m = at[has] + i, n[has] - i - 1
        total = int(m.sum())
        if not total:
            continue
        one = np.repeat(a, m)
        other = one + 1 + np.arange(total) - np.repeat(np.cumsum(m) - m, m)
        near = (np.bitwise_count(fps[one] ^ fps[other]) <= LINK_BITS) & (fps[one] != fps[other])
        lefts.append(fps[one[near]])
        rights.append(fps[other[near]])
    for g in np.flatnonzero((filed > 16) & (size > 1)):
        a, b = spanning_links(np.unique(fps[first[g] : first[g] + size[g]]))
        lefts.append(a)
        rights.append(b)
    if not lefts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(lefts), np.concatenate(rights)
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pair[:, 0], pair[:, 1]


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among sorted entries; the last group of a batch waits for the next batch."""
    held: list[np.ndarray] = []

    def emit(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        held = [np.concatenate(x) for x in zip(held, now)] if held else now
        whole = int(np.searchsorted(held[0], held[0][-1]))  # where the last key begins
        if whole:
            yield emit(*_links_of(held[0][:whole], held[1][:whole], held[2][:whole].view(np.uint64)))
            held = [x[whole:] for x in held]
    if held:
        yield emit(*_links_of(held[0], held[1], held[2].view(np.uint64)))


def _grouped(entries: DataFrame) -> DataFrame:
    return entries.repartition("key").sortWithinPartitions("key", "role").mapInArrow(_match, schema="a long, b long")


def _refile(level: int):
    """Entries of over-full groups, under their key and one of five parts of the bits that are free at this level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, mask, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            for fixed in np.unique(mask):
                here = mask == fixed
                free = [i for i in range(64) if not int(fixed) >> i & 1]
                for part in np.array_split(np.array(free), LINK_BITS + 1):
                    bits = 0
                    for i in part:
                        bits |= 1 << int(i)
                    sub = np.uint64(bits)
                    f = fp[here]
                    new = np.array(
                        [xxhash.xxh64_intdigest(b"%d %d %d %d" % (level, k, bits, v), SEED) for k, v in zip(key[here].tolist(), (f & sub).tolist())],
                        dtype=np.uint64,
                    )
                    out = [new.view(np.int64), np.full(len(f), int(fixed) | bits, np.uint64).view(np.int64), f.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["key", "mask", "fp"])

    return run


def links(distinct: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pairs (a, b) of fingerprints at distance 1 to LINK_BITS that span the components of all such pairs.

    distinct: one column fp long, without repeats.
    """
    def enumerate_balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, roles, rows = ball_entries(fps)
            out = [keys.view(np.int64), roles, fps[rows].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["key", "role", "fp"])

    entries = distinct.select("fp").mapInArrow(enumerate_balls, schema="key long, role byte, fp long")
    entries = cut(entries)
    hot = cut(entries.groupBy("key").agg(F.count("*").alias("n"), F.min("role").alias("r")).where(f"n > {group_rows}"))
    found = _grouped(entries.join(hot.select("key"), "key", "left_anti") if hot.limit(1).count() else entries)
    if not hot.limit(1).count():
        return found
    # which bits a key fixes: those of its segment; a probing entry differs in one of them, so none of it is fixed
    fixed = [0 if r else ((1 << w) - 1) << at for at, w, r in SEGMENTS]
    mask = F.lit(0).cast("long")
    for s, bits in enumerate(fixed):
        mask = F.when(F.shiftright("key", 32) == s, F.lit(bits - (1 << 64) if bits >= 1 << 63 else bits).cast("long")).otherwise(mask)
    crowded = entries.join(hot.where("r = 0").select("key"), "key", "left_semi").select("key", mask.alias("mask"), "fp")
    for level in range(1, 32):
        crowded = cut(crowded.mapInArrow(_refile(level), schema="key long, mask long, fp long"))
        stat = crowded.groupBy("key", "mask").agg(F.count("*").alias("n"))
        # with 16 bits or fewer free a group has at most 65,536 distinct members: small enough for one task
        over = cut(stat.where((F.col("n") > group_rows) & (F.bit_count("mask") < 48)).select("key"))
        if not over.limit(1).count():
            return found.unionAll(_grouped(crowded.select("key", F.lit(0).cast("byte").alias("role"), "fp")))
        done = crowded.join(over, "key", "left_anti")
        found = found.unionAll(_grouped(done.select("key", F.lit(0).cast("byte").alias("role"), "fp")))
        crowded = crowded.join(over, "key", "left_semi")
    raise RuntimeError("groups did not get small")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """Rows (id_col, fp long, component_id): the least id_col whose document is reachable over links.

    Null texts and texts without words have fingerprint zero, and link like any other. Rows with equal or null ids are
    rows of their own; a null id is never a component's id unless all its ids are null. An empty table gives an empty
    result; other columns of df are not read. One row per row of df. A result column of the name id_col is written with an
    underscore before it.
    """
    fps = cut(fingerprints(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text", width))
    distinct = cut(fps.groupBy("fp").agg(F.min("_id").alias("least")))
    found = components(links(distinct))
    # a component's id, on its fingerprints only; then every fingerprint's
    named = found.join(distinct, found.node == distinct.fp).groupBy("root").agg(F.min("least").alias("component"))
    linked = found.join(named, "root").select(F.col("node").alias("fp2"), "component")
    table = distinct.join(linked, distinct.fp == linked.fp2, "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    table = cut(table)
    return fps.join(table, "fp").select(F.col("_id").alias(id_col), *beside(id_col, "fp", "component_id"))


def hex_digits(fp: str = "fp"):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
