"""Benchmark items inside documents: size-partitioned MinHash containment search with exact verification.

Items are partitioned by their number of distinct word shingles, each partition up to twice as large as the one before,
and every partition has an index and a signature size m of its own. An item's signature is the m smallest hashes of its
shingles under one hash order (a bottom-m MinHash). If an item of n shingles has at least a share t of them in a document,
at most n - ceil(t * n) are missing, so m is n - ceil(t * n) + 1 for the largest n of the partition, and a member of it
whose signature a document meets in fewer than its m less those that may be missing is no candidate. The search is thus
complete whatever a document's length, where the usual estimate of containment from equally sized signatures loses short
items in long documents. A document probes every partition with all its shingles; candidates are verified by exact
containment of the shingles themselves.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import beside, free_name, tune

WIDTH = 5
THRESHOLD = 0.8
#: Text bytes of the items that are sent to every task at once; larger benchmarks are searched in several passes.
BLOCK_BYTES = 8 << 20
#: ASCII characters that belong to words; all characters beyond ASCII do.
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
_in_word = np.zeros(256, dtype=bool)
_in_word[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_POWERS = _rng.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _rng.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FILTER_BITS = 20
PART_BYTES = 4 << 20


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return WORD.findall((text or "").lower())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of lower-cased UTF-8 bytes, and where each begins. Long texts are taken in parts."""
    parts, at = [], 0
    while True:
        to = min(len(data), at + PART_BYTES)
        while to < len(data) and _in_word[data[to]]:  # a part ends between words
            to += 1
        hashes, starts = _hashes_of_part(data[at:to])
        parts.append((hashes, starts + at))
        at = to
        if at >= len(data):
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _hashes_of_part(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(data, dtype=np.uint8)
    inside = _in_word[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    letters = np.flatnonzero(inside)
    n = ends - starts
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    within = np.arange(len(letters)) - np.repeat(first, n)
    terms = (b[letters].astype(np.uint64) + np.uint64(1)) * _POWERS[within & 4095]
    return _mix(np.add.reduceat(terms, first) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h += words[j : j + n] * _STEPS[j]
    return _mix(h)


def shingles(words: list[str], width: int) -> set[str]:
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def missing(n: int, threshold: float) -> int:
    """How many of n shingles a document may lack."""
    return n - math.ceil(threshold * n - 1e-9)


class Partition:
    """Items of one shingle width whose numbers of shingles have the same bit length."""

    def __init__(self, sizes: list[int], threshold: float):
        self.m = missing(max(sizes), threshold) + 1
        self.hashes: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []

    def add(self, number: int, distinct: np.ndarray) -> None:
        """File the m smallest of the item's ascending hashes."""
        self.hashes.append(distinct[: self.m])
        self.owners.append(np.full(len(self.hashes[-1]), number))

    def close(self) -> None:
        h, o = np.concatenate(self.hashes), np.concatenate(self.owners)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner = h[order], o[order]
        self.seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def met(self, s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and items of every signature hash that a shingle hash equals; doc: each shingle's document."""
        at = np.flatnonzero(self.seen[(s >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        pair = np.unique(np.stack([doc[at].astype(np.uint64), s[at]], axis=1), axis=0)  # a shingle counts once in a document
        lo, hi = np.searchsorted(self.hash, pair[:, 1], "left"), np.searchsorted(self.hash, pair[:, 1], "right")
        n = hi - lo
        ends = np.cumsum(n)
        which = np.repeat(lo - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.repeat(pair[:, 0].astype(np.int64), n), self.owner[which]


class Signatures:
    """Items by size partition, their bottom-m hashes, and the texts to verify with."""

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float):
        self.threshold, self.items = threshold, []
        found: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for key, text in items:
            words = words_of(text)
            if not words:
                continue  # nothing to find
            w = min(width, len(words))  # fewer words: the whole sequence is the one shingle
            own = shingles(words, w)
            hashes, _ = word_hashes(" ".join(words).encode("utf-8", "surrogatepass"))
            distinct = np.unique(shingle_hashes(hashes, w))
            found.setdefault((w, len(distinct).bit_length()), []).append((len(self.items), distinct))
            self.items.append((key, w, own))
        self.partitions: list[tuple[int, Partition]] = []
        self.least = np.zeros(len(self.items), dtype=np.int64)  # signature hashes that a candidate's document meets
        for (w, _), members in sorted(found.items()):
            p = Partition([len(d) for _, d in members], threshold)
            for number, distinct in members:
                p.add(number, distinct)
                self.least[number] = min(p.m, len(distinct)) - missing(len(distinct), threshold)
            p.close()
            self.partitions.append((w, p))

    def candidates(self, hashes: np.ndarray, owner: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs that share enough signature hashes; owner: the document of each word."""
        out: set[tuple[int, int]] = set()
        probes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w, p in self.partitions:
            if w not in probes:
                s = shingle_hashes(hashes, w)
                inside = np.flatnonzero(owner[: len(s)] == owner[w - 1 : w - 1 + len(s)])
                probes[w] = s[inside], owner[inside]
            docs, items = p.met(*probes[w])
            pairs, times = np.unique(np.stack([docs, items], axis=1), axis=0, return_counts=True)
            enough = times >= self.least[pairs[:, 1]]
            out.update(zip(pairs[enough, 0].tolist(), pairs[enough, 1].tolist()))
        return out


def _search(texts: list[str], signatures: Signatures) -> Iterator[tuple[int, int, int, int]]:
    """(text number, item id, shared shingles, the item's shingles) of verified pairs."""
    lowered = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(t) + 1 for t in lowered])
    hashes, starts = word_hashes(b"\n".join(lowered))
    owner = np.searchsorted(ends, starts, side="right")
    by_doc: dict[int, list[int]] = {}
    for doc, item in signatures.candidates(hashes, owner):
        by_doc.setdefault(doc, []).append(item)
    for doc, items in sorted(by_doc.items()):
        words = words_of(texts[doc])
        held: dict[int, set[str]] = {}
        for item in sorted(items):
            key, w, own = signatures.items[item]
            if w not in held:
                held[w] = shingles(words, w)
            shared = len(own & held[w])
            if shared >= signatures.threshold * len(own) - 1e-9:
                yield doc, key, shared, len(own)


#: Characters that are searched together; a longer text is searched alone.
GROUP_CHARS = 2_000_000


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Rows (id_col, item_id, shared, size): pairs in which the document has a share >= threshold of the item's shingles.

    Shingles are distinct runs of `width` lower-cased words (of all words in an item with fewer). Null or wordless texts
    and items match nothing. Rows of equal or null id are searched each; an empty table on either side gives no row. The
    items are sent to the tasks in blocks of at most BLOCK_BYTES (a single longer item is a block), one pass over the
    documents a block; there is no shuffle. A result column of the name id_col is written with an underscore before it.
    """
    tune(docs.sparkSession)
    key = docs.schema[id_col].dataType
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = f"_id {key.simpleString()}, item_id long, shared int, size int"

    def search(block: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            signatures = Signatures(block, width, threshold)
            for batch in batches:
                for at, texts in _groups([t or "" for t in batch.column(1).to_pylist()]):
                    found = list(_search(texts, signatures))
                    if found:
                        ids = batch.column(0).take(pa.array([at + f[0] for f in found]))
                        cols = [pa.array([f[i] for f in found], t) for i, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()))]
                        yield pa.RecordBatch.from_arrays([ids, *cols], names=["_id", "item_id", "shared", "size"])

        return run

    out = None
    for block in _blocks(items, item_col, item_text_col):
        part = named.mapInArrow(search(block), schema=schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = named.where(F.lit(False)).select("_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("shared"), F.lit(0).alias("size"))
    return out.select(F.col("_id").alias(id_col), *beside(id_col, "item_id", "shared", "size"))


def without_items(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item in the sense of contaminated(). Null texts stay."""
    tune(docs.sparkSession)
    text = free_name(docs, "_text")
    out = docs.withColumn(text, F.col(text_col).cast("string"))

    def sift(block: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            signatures = Signatures(block, width, threshold)
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for at, texts in _groups([t or "" for t in batch.column(text).to_pylist()]):
                    clean[[at + f[0] for f in _search(texts, signatures)]] = False
                yield batch.filter(pa.array(clean))

        return run

    for block in _blocks(items, item_col, item_text_col):
        out = out.mapInArrow(sift(block), schema=out.schema)
    return out.drop(text)


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of GROUP_CHARS together, and where each begins."""
    at = 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars + len(texts[to]) <= GROUP_CHARS):
            chars += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def _blocks(items: DataFrame, item_col: str, item_text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of BLOCK_BYTES; the driver holds one at a time."""
    block, size = [], 0
    for row in items.select(F.col(item_col).cast("long").alias("k"), F.col(item_text_col).cast("string").alias("t")).toLocalIterator():
        n = len(row.t or "") * 4
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row.k, row.t or ""))
        size += n
    if block:
        yield block
