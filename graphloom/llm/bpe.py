"""Byte-level BPE encoding and decoding with a pair occurrence index.

Every text is cut into pieces, and the distinct pieces of a run of a partition's rows (GROUP_CHARS characters, which bounds
memory) that were not met before are encoded together: an index maps each adjacent pair of symbols to all its positions
in them, the active ranks are taken from a heap in ascending order, and a merge rewrites all the pair's positions at once
and updates the position lists of the pairs on either side. Learned pieces are numbered and remembered, up to a bound in
bytes, so that a frequent word is merged once per worker.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import beside, tune

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a worker's remembered pieces, about; beyond them all are forgotten, which costs time, never results.
MEMORY = 96 << 20
#: What a remembered piece costs besides its letters and ids.
PIECE = 160
#: Positions of a pair from which on they are merged together by array operations instead of one by one.
WHOLE = 48
#: Tokens that are decoded at once.
DECODED = 1 << 18
#: Stands between words in the symbol list; no id has this value.
GAP = 0xFFFF


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character, as byte-level vocabularies write their tokens."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return out

#: Characters below this are handled by a simpler pattern.
SIMPLE = 0x250


def _simple_pattern() -> str:
    """PATTERN for texts whose characters all lie below SIMPLE, with plain character classes."""
    kind = {k: "".join(chr(c) for c in range(SIMPLE) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    blank = r" \t\n\r\x0b\x0c\x85\xa0"
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{kind['L']}]+| ?[{kind['N']}]+| ?[^{blank}{kind['L']}{kind['N']}]+"
        rf"|[{blank}]+(?![^{blank}])|[{blank}]+"
    )


#: Up to Latin Extended-B the standard library's pattern engine serves, which is several times as fast.
simple_split = re.compile(_simple_pattern()).findall
beyond = re.compile(f"[^\\x00-\\u{SIMPLE - 1:04x}]").search


class _Numbers(dict):
    """Piece to number; a new piece gets the next one and is noted."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        return n


class BytePairCodec:
    """Encoder and decoder of one tokenizer file (JSON with vocab and merges)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        letters = byte_alphabet()
        back = {c: b for b, c in letters.items()}
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        if max(vocab.values()) >= GAP:
            raise ValueError("pairs are written in 32 bits: at most 65,535 ids")
        self.rank: dict[int, int] = {}
        self.merged: dict[int, int] = {}
        for i, m in enumerate(model["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            pair = vocab[x] << 16 | vocab[y]
            self.rank[pair], self.merged[pair] = i, vocab[x + y]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes: dict[int, bytes] = {
            i: b"".join(bytes((back[c],)) if c in back else c.encode() for c in t) for t, i in vocab.items()
        }
        self.token_bytes |= {i: t.encode() for t, i in self.specials.items()}
        self.split = regex.compile(PATTERN).findall
        self.special_split = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
            if self.specials
            else None
        )
        most = max(self.token_bytes, default=-1) + 1
        self.token_size = np.zeros(most, dtype=np.int64)
        for i, t in self.token_bytes.items():
            self.token_size[i] = len(t)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_data = np.frombuffer(b"".join(self.token_bytes.get(i, b"") for i in range(most)), dtype=np.uint8)
        self.forget()

    def forget(self) -> None:
        self.numbers, self.held = _Numbers(), 0
        for t in self.specials:
            self.numbers[t] = len(self.numbers)
        self.piece_ids = np.array(list(self.specials.values()), dtype=np.int32)
        self.piece_ends = np.arange(1, len(self.specials) + 1, dtype=np.int64)

    def learn(self) -> None:
        """Encode the noted pieces and remember them."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if not fresh:
            return
        ids, sizes = self.merge_all(fresh)
        last = int(self.piece_ends[-1]) if len(self.piece_ends) else 0
        self.piece_ids = np.concatenate((self.piece_ids, ids))
        self.piece_ends = np.concatenate((self.piece_ends, last + np.cumsum(sizes)))
        self.held += 4 * len(ids) + PIECE * len(fresh) + sum(map(len, fresh))

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and the number of each word's, merged together. A pair (x, y) is written as x << 16 | y."""
        working = gc.isenabled()
        gc.disable()  # many short lists and no cycles
        try:
            return self._merge_all(words)
        finally:
            if working:
                gc.enable()

    def _merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [w.encode("utf-8") for w in words]
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        data = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)
        ends = np.cumsum(size + 1) - 1
        first = np.array(self.byte_id, dtype=np.int32)[data]
        first[ends] = GAP  # no pair spans two words
        n = len(first)
        codes = (first[:-1].astype(np.uint32) << np.uint32(16)) | first[1:].astype(np.uint32)
        order = np.argsort(codes, kind="stable").astype(np.int32)  # positions of a pair side by side, ascending
        ordered = codes[order]
        runs = np.flatnonzero(np.diff(ordered, prepend=ordered[0] ^ np.uint32(1)))
        rank = self.rank
        met: dict[int, int] = {p: i for i, p in enumerate(ordered[runs].tolist()) if p in rank}  # where a pair's positions begin
        bounds = np.append(runs, len(ordered))
        del codes, ordered
        # compact arrays, one memory under a view for single places and one for whole position lists
        sym, nxt, prv = array("i", first.tobytes()), array("i", np.arange(1, n + 1, dtype=np.int32).tobytes()), array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
        syms, nexts, prevs = (np.frombuffer(x, dtype=np.int32) for x in (sym, nxt, prv))
        where: dict[int, list[int]] = {}  # positions that merges have made, one by one
        lists: dict[int, list[np.ndarray]] = {}  # and whole lists of them
        active = [rank[p] << 32 | p for p in met]
        heapq.heapify(active)
        pop, push, merged_of = heapq.heappop, heapq.heappush, self.merged
        while active:
            pair = pop(active) & 0xFFFFFFFF
            spots, parts, run = where.pop(pair, []), lists.pop(pair, []), met.pop(pair, None)
            if run is not None:
                parts.append(order[bounds[run] : bounds[run + 1]])
            if pair >> 16 != pair & 0xFFFF and len(spots) + sum(map(len, parts)) >= WHOLE:
                for code, places in self._merge_list(pair, [np.array(spots, dtype=np.int32), *parts], syms, nexts, prevs):
                    if code in lists:
                        lists[code].append(places)
                    elif code in rank:
                        lists[code] = [places]
                        push(active, rank[code] << 32 | code)
                continue
            for x in parts:
                spots += x.tolist()
            a, b = pair >> 16, pair & 0xFFFF
            merged = merged_of[pair]
            if a == b:
                spots.sort()  # where three meet, the left two merge
            high = merged << 16
            for i in spots:
                j = nxt[i]
                if sym[i] != a or sym[j] != b:
                    continue  # another merge took one of the two
                k = nxt[j]
                sym[i] = merged
                sym[j] = -2
                nxt[i] = k
                prv[k] = i  # a gap ends every word, so k exists
                right = high | sym[k]
                if right in where:
                    where[right].append(i)
                elif right in rank:
                    where[right] = [i]
                    push(active, rank[right] << 32 | right)
                h = prv[i]
                if h >= 0:
                    left = sym[h] << 16 | merged
                    if left in where:
                        where[left].append(h)
                    elif left in rank:
                        where[left] = [h]
                        push(active, rank[left] << 32 | left)
        kept = syms >= 0
        kept[ends] = False
        sizes = np.add.reduceat(kept.astype(np.int64), np.concatenate(([0], ends[:-1] + 1)))
        return syms[kept], sizes

    def _merge_list(self, pair: int, parts: list[np.ndarray], syms: np.ndarray, nexts: np.ndarray, prevs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Merge a pair of unlike symbols at all its positions at once; the pairs that this makes and their positions."""
        merged = self.merged[pair]
        at = np.unique(np.concatenate(parts))
        after = nexts[at]
        whole = (syms[at] == pair >> 16) & (syms[after] == pair & 0xFFFF)  # no other merge took one of the two
        at, after = at[whole], after[whole]
        beyond = nexts[after]
        syms[at], syms[after] = merged, -2
        nexts[at], prevs[beyond] = beyond, at
        before = prevs[at]
        # before a text's first symbol stands the last gap's place, which makes no pair of any rank
        codes = np.concatenate((merged << 16 | syms[beyond].astype(np.int64), syms[before].astype(np.int64) << 16 | merged))
        places = np.concatenate((at, before))
        order = np.argsort(codes, kind="stable")
        codes, places = codes[order], places[order]
        begins = np.flatnonzero(np.diff(codes, prepend=-1))
        bounds = [*begins.tolist(), len(codes)]
        for i, code in enumerate(codes[begins].tolist()):
            if code in self.rank:
                yield code, places[bounds[i] : bounds[i + 1]]

    def words_of(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces; a special token of the text is a piece of its own."""
        if not any(s in text for s in self.specials):
            return (simple_split if beyond(text) is None else self.split)(text)
        out: list[str] = []
        for part in self.special_split.split(text):
            out += [part] if part in self.specials else self.split(part) if part else []
        return out

    def encode_group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the number of each text's. Pieces not met before are merged together, over one pair index."""
        if self.held > MEMORY:
            self.forget()
        known = self.numbers.__getitem__
        cut = []
        for t in texts:
            words = self.words_of(t)
            cut.append(np.fromiter(map(known, words), dtype=np.int32, count=len(words)))
        self.learn()
        pieces = np.concatenate(cut) if cut else np.zeros(0, np.int32)
        begins = np.concatenate(([0], self.piece_ends[:-1])) if len(self.piece_ends) else self.piece_ends
        size = (self.piece_ends - begins)[pieces]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(begins[pieces] - (ends - size), size) + np.arange(total)
        per_text = np.add.reduceat(np.append(size, 0), np.minimum(np.cumsum([0, *map(len, cut[:-1])]), len(size))) if cut else size
        per_text[[not len(c) for c in cut]] = 0
        return self.piece_ids[at], per_text

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of every text."""
        ids, sizes = self.encode_group(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []

    def decode_group(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        ids = ids[(ids >= 0) & (ids < len(self.token_size))] if len(ids) and (ids.min() < 0 or ids.max() >= len(self.token_size)) else ids
        data = bytearray()
        for i in range(0, len(ids), DECODED):
            part = ids[i : i + DECODED]
            size = self.token_size[part]
            ends = np.cumsum(size)
            data += self.token_data[np.repeat(self.token_at[part] - (ends - size), size) + np.arange(int(ends[-1]))].tobytes()
        ends = np.concatenate(([0], np.cumsum(self.token_size[ids])))[np.cumsum(sizes)] if len(sizes) else sizes
        out, a = [], 0
        for b in ends.tolist():
            out.append(data[a:b].decode("utf-8", errors="replace"))
            a = b
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters, unknown ids nothing."""
        known = self.token_bytes
        return b"".join([known.get(i, b"") for i in ids]).decode("utf-8", errors="replace")


_codecs: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    """One codec per worker and file."""
    if path not in _codecs:
        _codecs[path] = BytePairCodec(path)
    return _codecs[path]


#: Characters that are encoded together at most; a longer text is encoded alone.
GROUP_CHARS = 1_000_000


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Runs of rows across batches, as their ids and texts."""
    ids: list[pa.Array] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        begin = 0
        for i, t in enumerate(batch.column(1).to_pylist()):
            t = t or ""
            if texts and size + len(t) > GROUP_CHARS:
                ids.append(batch.column(0).slice(begin, i - begin))
                yield pa.concat_arrays(ids), texts
                ids, texts, size, begin = [], [], 0, i
            texts.append(t)
            size += len(t)
        ids.append(batch.column(0).slice(begin))
    if texts:
        yield pa.concat_arrays(ids), texts


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, ids array<int>, decoded string), one per row of df; no other column of df is read.

    Null text counts as empty: no ids and an empty decoded text. Null or repeated ids are passed through, an empty
    table gives an empty result, and a text is always encoded whole. A result column of the name id_col is written with an
    underscore before it. No shuffle.
    """
    tune(df.sparkSession)
    key = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for keys, texts in _groups(batches):
            flat, sizes = c.encode_group(texts)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            decoded = pa.array(c.decode_group(flat, sizes), type=pa.string())
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), decoded], names=["_id", "ids", "decoded"])

    named = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = named.mapInArrow(run, schema=f"_id {key.simpleString()}, ids array<int>, decoded string")
    return out.select(F.col("_id").alias(id_col), *beside(id_col, "ids", "decoded"))
