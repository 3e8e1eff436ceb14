"""Language-model scores: masked pseudo-likelihood by a bidirectional window network trained in numpy.

Every token is predicted from the tokens on both of its sides, itself masked; a document's score is the sum of the
conditional log-probabilities of its tokens. The corpus counts all words: the frequent ones are the network's vocabulary,
rarer ones share hashed buckets, and p(word) = p(bucket) * p(word in bucket), the latter from the full counts: n / (N + 1)
of a word counted n times in a bucket of N counts; words never counted share the one left over. Tokens of like frequency
form classes, and p(token) = p(class) * p(token in class), each a softmax over the hidden state, so a prediction costs the
square root of the vocabulary.

The network is first fitted on the driver on a bounded sample of whole documents, which only gives a start; then every
task goes over all positions of its documents from there on, and the tasks' parameters are averaged with their numbers of
positions as weights: every token of every document is predicted once, however short or long its text. What a task learns
depends on which documents it holds, so other numbers of partitions give somewhat other parameters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import beside, cut, sample_ids, tune

SIDE = 32
VOCABULARY = SIDE * SIDE
HASHED = 64
OFFSETS = (-3, -2, -1, 1, 2, 3)
HIDDEN = 12
#: Documents of the driver's first fit, at most, and the bytes of the longest of them.
FIT_DOCS, FIT_BYTES = 400, 1 << 16
#: Positions of one step of the tasks' pass, and its rate.
STEP, RATE = 2048, 1.0
#: Words that a task counts before it hands its counts on, and the longest word of the vocabulary.
COUNTED, LONGEST = 200_000, 64
#: Bucketed words, at most, whose counts every task holds; counts of the others are joined.
LISTED = 1 << 17
#: Slices of the parameters that are averaged apart, and groups of tasks that are averaged first.
SLICES, FAN = 8, 64
CHUNK = 16384


def tokens_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (word, n) over all texts; counted in the tasks before words are shuffled."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(tokens_of(t))
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    part = df.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema="word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """Token number of a word; a word not in the network's vocabulary gets one of the hashed buckets.

    listed: bucketed words and their counts. in_bucket: the counts of each bucket. rest: rows (word, n) of the bucketed
    words not listed that are counted more than once, or None; it stays on the driver.
    """

    def __init__(self, words: list[str], listed: dict[str, int] | None = None, in_bucket: np.ndarray | None = None, rest: DataFrame | None = None):
        super().__init__({w: i for i, w in enumerate(words)})
        self.first = VOCABULARY - HASHED
        self.words, self.listed, self.rest = list(words), listed or {}, rest
        self.in_bucket = np.zeros(HASHED) if in_bucket is None else in_bucket
        self.update({w: self.__missing__(w) for w in self.listed})

    def __missing__(self, word: str) -> int:
        return self.first + crc32(word.encode("utf-8", "surrogatepass")) % HASHED

    def __reduce__(self):
        return Vocabulary, (self.words, self.listed, self.in_bucket)

    def in_buckets(self) -> dict[int, float]:
        """Minus the logarithm of what a bucket's words share, by token."""
        return {self.first + b: -float(np.log(n + 1)) for b, n in enumerate(self.in_bucket)}


def with_counts(words: dict[str, int], counts: DataFrame, listed: int) -> Vocabulary:
    """The vocabulary of the words, with the counts of all others: at most `listed` held, the rest as rows."""
    short = F.char_length("word") <= LONGEST
    least, held = None, 0
    for r in counts.where(short).groupBy("n").agg(F.count("*").alias("words")).orderBy(F.col("n").desc()).collect():
        held += r.words
        if held > listed + len(words):
            break
        least = r.n
    is_listed = short & (F.col("n") >= least) if least is not None else F.lit(False)
    found = counts.where(is_listed).toArrow()
    kept = {w: n for w, n in zip(found.column("word").to_pylist(), found.column("n").to_pylist()) if w not in words}
    in_bucket, bucket = np.zeros(HASHED), F.crc32(F.col("word").cast("binary")) % HASHED
    for r in counts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect():
        in_bucket[r.b] = r.n
    for w, n in words.items():
        in_bucket[crc32(w.encode()) % HASHED] -= n
    rest = counts.where(~is_listed & (F.col("n") > 1) & ~F.col("word").isin(list(words)))
    return Vocabulary(list(words), kept, in_bucket, rest)


def encode(vocab: Vocabulary, text: str | None) -> np.ndarray:
    words = tokens_of(text)
    return np.fromiter(map(vocab.__getitem__, words), dtype=np.int32, count=len(words))


class Network:
    """Parameters in one vector, with named views of it."""

    SHAPES = (("emb", (len(OFFSETS), VOCABULARY + 1, HIDDEN)), ("hb", (HIDDEN,)), ("cw", (HIDDEN, SIDE)), ("cb", (SIDE,)), ("tw", (SIDE, HIDDEN, SIDE)), ("tb", (SIDE, SIDE)))

    def __init__(self, flat: np.ndarray | None = None, seed: int = 3):
        size = sum(int(np.prod(s)) for _, s in self.SHAPES)
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = rng.normal(0, 0.05, size).astype(np.float32)
        self.flat = np.array(flat, dtype=np.float32)
        at = 0
        for name, shape in self.SHAPES:
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    def start_from(self, counts: np.ndarray) -> None:
        """Output biases of the corpus frequencies."""
        p = (counts + 1).reshape(SIDE, SIDE).astype(np.float64)
        self.cb[:] = np.log(p.sum(axis=1) / p.sum())
        self.tb[:] = np.log(p / p.sum(axis=1, keepdims=True))

    def hidden(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """States of the positions `at` of a token row that has three pads before and behind each text."""
        z = self.emb[0].take(padded.take(at + OFFSETS[0]), axis=0)
        for j, o in enumerate(OFFSETS[1:], 1):
            z += self.emb[j].take(padded.take(at + o), axis=0)
        z += self.hb
        return np.tanh(z, out=z)

    def log_probabilities(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the tokens at the positions, given both sides."""
        out = np.empty(len(at), dtype=np.float64)
        for i in range(0, len(at), CHUNK):
            pos = at[i : i + CHUNK]
            order, c, w, bounds = _by_class(padded[pos])
            h = self.hidden(padded, pos[order])
            part = _chosen(h @ self.cw + self.cb, c)
            for k in range(SIDE):
                rows = slice(bounds[k], bounds[k + 1])
                if bounds[k] < bounds[k + 1]:
                    part[rows] += _chosen(h[rows] @ self.tw[k] + self.tb[k], w[rows])
            out[i + order] = part
        return out

    def step(self, padded: np.ndarray, at: np.ndarray, rate: float) -> None:
        """One stochastic gradient step on the positions."""
        order, c, w, bounds = _by_class(padded[at])
        at = at[order]
        h = self.hidden(padded, at)
        every = np.arange(len(at))
        g = _soft(h @ self.cw + self.cb)
        g[every, c] -= 1
        gh = g @ self.cw.T
        scale = rate / len(at)
        self.cw -= scale * (h.T @ g)
        self.cb -= scale * g.sum(axis=0)
        met = np.flatnonzero(np.diff(bounds))
        g = self.tb[c]
        for k in met:
            g[bounds[k] : bounds[k + 1]] += h[bounds[k] : bounds[k + 1]] @ self.tw[k]
        g = _soft(g)
        g[every, w] -= 1
        for k in met:
            rows = slice(bounds[k], bounds[k + 1])
            gh[rows] += g[rows] @ self.tw[k].T
            self.tw[k] -= scale * (h[rows].T @ g[rows])
        if len(met):
            self.tb[met] -= scale * np.add.reduceat(g, bounds[met], axis=0)
        gz = np.clip(gh * (1 - h * h), -1, 1) * np.float32(rate / 64)
        self.hb -= gz.mean(axis=0)
        flat, first = gz.astype(np.float64).ravel(), padded.take(at[:, None] + np.array(OFFSETS)).astype(np.int64) * HIDDEN
        for j in range(len(OFFSETS)):
            cells = first[:, j, None] + np.arange(HIDDEN)
            moved = np.bincount(cells.ravel(), flat, (VOCABULARY + 1) * HIDDEN)
            self.emb[j] -= moved.reshape(VOCABULARY + 1, HIDDEN)


def _by_class(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order by class of tokens, their classes and places within them in that order, and where each class begins."""
    order = np.argsort((y // SIDE).astype(np.uint8), kind="stable")
    c, w = np.divmod(y[order], SIDE)
    return order, c, w, np.searchsorted(c, np.arange(SIDE + 1))


#: Logits are kept within this, in place of taking each row's greatest off, which no sum of so few powers needs.
LOGIT = 60.0
_ones = np.ones(SIDE, dtype=np.float32)


def _soft(z: np.ndarray) -> np.ndarray:
    np.clip(z, -LOGIT, LOGIT, out=z)
    np.exp(z, out=z)
    z /= (z @ _ones)[:, None]
    return z


def _chosen(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    np.clip(z, -LOGIT, LOGIT, out=z)
    picked = z[np.arange(len(z)), at].astype(np.float64)
    np.exp(z, out=z)
    return picked - np.log((z @ _ones).astype(np.float64))


def padded_row(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one row with three pads around each, and the positions of their tokens."""
    pad = np.full(3, VOCABULARY, dtype=np.int32)
    parts, at, n = [pad], [], 3
    for r in rows:
        parts += [r, pad]
        at.append(np.arange(n, n + len(r)))
        n += len(r) + 3
    return np.concatenate(parts), np.concatenate(at) if at else np.zeros(0, np.int64)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS) -> tuple[Vocabulary, Network]:
    """Vocabulary, counts and network of the texts. The driver holds a vocabulary, LISTED counts and fit_docs documents' tokens at most."""
    tune(df.sparkSession)
    counts = cut(word_counts(df, text_col))
    top = counts.where(F.char_length("word") <= LONGEST).orderBy(F.col("n").desc(), "word").limit(VOCABULARY - HASHED).collect()
    vocab = with_counts({r.word: r.n for r in top}, counts, LISTED)
    n = np.zeros(VOCABULARY)
    n[: len(top)] = [r.n for r in top]
    n[VOCABULARY - HASHED :] = vocab.in_bucket
    net = Network()
    net.start_from(n)

    ids = sample_ids(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_pick")).distinct(), "_pick", fit_docs)
    named = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [encode(vocab, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["_id", "tokens"])

    key = df.schema[id_col].dataType.simpleString()
    short = named.where(F.octet_length("_text") <= FIT_BYTES)
    got = short.join(F.broadcast(ids), F.col("_id") == F.col("_pick"), "left_semi").mapInArrow(tokenise, schema=f"_id {key}, tokens array<int>")
    rows = [np.asarray(r.values, dtype=np.int32) for r in got.toArrow().sort_by("_id").column("tokens")]
    row, at = padded_row(rows)
    rng = np.random.default_rng(9)
    for epoch in range(3 if len(at) else 0):
        order = rng.permutation(at)
        for i in range(0, len(order), 1024):
            net.step(row, order[i : i + 1024], 1.0 / (1 + epoch))
    begin = net.flat.copy()

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, positions = Network(begin), 0
        task = None
        for batch in batches:
            row, at = padded_row([encode(vocab, t) for t in batch.column(1).to_pylist()])
            task = crc32(str(batch.column(0)[0]).encode()) if task is None and batch.num_rows else task
            at = np.random.default_rng(task or 0).permutation(at)
            for i in range(0, len(at), STEP):
                own.step(row, at[i : i + STEP], RATE)
            positions += len(at)
        if positions:
            parts = np.array_split(own.flat - begin, SLICES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(SLICES, (task or 0) % FAN)), pa.array(np.arange(SLICES)), pa.array(np.full(SLICES, positions)), pa.array(parts, pa.list_(pa.float32()))],
                names=["fan", "slice", "n", "delta"],
            )

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        total, n = 0.0, int(pdf["n"].sum())
        for d, m in zip(pdf["delta"], pdf["n"]):
            total = total + np.asarray(d, dtype=np.float64) * (m / n)
        return pd.DataFrame({"fan": [0], "slice": [int(pdf["slice"].iloc[0])], "n": [n], "delta": [total.astype(np.float32)]})

    schema = "fan long, slice long, n long, delta array<float>"
    moved = named.mapInArrow(go_on, schema=schema)
    moved = moved.groupBy("fan", "slice").applyInPandas(average, schema).groupBy("slice").applyInPandas(average, schema)
    parts = {r.slice: r.delta for r in moved.collect()}
    if parts:
        net = Network(begin + np.concatenate([np.asarray(parts[i], np.float32) for i in range(SLICES)]))
    return vocab, net


class _Known(dict):
    """Places of known words; others get -1 and are noted in order."""

    def __missing__(self, word: str) -> int:
        self.missed.append(word)
        return -1


def score(df: DataFrame, vocab: Vocabulary, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_tokens, log_probability), one per row of df; whole texts, other columns unread.

    Null texts and texts without words have no tokens and a log-probability of 0. Ids are passed through, and a result
    column of the name id_col is written with an underscore before it. Only words whose
    counts the tasks don't hold are shuffled, to the rest of the counts and back to their rows; rows are told apart by
    their places, so df must give its rows in the same order when a task is repeated, as a table's files do.
    """
    tune(df.sparkSession)
    key, flat = df.schema[id_col].dataType.simpleString(), net.flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shared = Network(flat), vocab.in_buckets()
        known = _Known({w: i for i, w in enumerate([*vocab.words, *vocab.listed])})
        token = np.array([vocab[w] for w in known], dtype=np.int32)
        within = np.zeros(len(known))
        within[len(vocab.words) :] = np.log(list(vocab.listed.values())) + [shared[vocab[w]] for w in vocab.listed]
        if not known:  # one place to index where nothing is counted
            token, within = np.zeros(1, np.int32), np.zeros(1)
        for batch in batches:
            known.missed = []
            rows = [tokens_of(t) for t in batch.column(2).to_pylist()]
            rows = [np.fromiter(map(known.__getitem__, r), dtype=np.int32, count=len(r)) for r in rows]
            size = np.array([len(r) for r in rows], dtype=np.int64)
            ends = np.concatenate(([0], np.cumsum(size)))
            places = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            new, missed = np.flatnonzero(places < 0), known.missed
            tokens = token[places]
            tokens[new] = [vocab[w] for w in missed]
            row, at = padded_row(np.split(tokens, ends[1:-1]))
            lp = own.log_probabilities(row, at) + within[places]
            lp[new] += np.array([shared[t] for t in tokens[new].tolist()]) - within[places[new]]
            total = np.array([lp[a:b].sum() for a, b in zip(ends[:-1], ends[1:])], dtype=np.float64)
            # a row for each text, under a word that is none, and one for each of its words that no task holds
            nth = batch.column(0).to_pylist()
            found = Counter(zip((np.searchsorted(ends, new, side="right") - 1).tolist(), missed))
            of = [nth[i] for i, _ in found]
            none = pa.nulls(len(of), batch.column(1).type)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f" {i}" for i in nth], pa.string()), pa.array(np.zeros(len(nth), np.int64)), pa.array(size), pa.array(total)], names=names
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.int64()), none, pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64()), pa.array(np.zeros(len(of), np.int64)), pa.array(np.zeros(len(of)))], names=names
            )

    names = ["_row", "_id", "word", "times", "n_tokens", "lp"]
    named = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = named.mapInArrow(run, schema=f"_row long, _id {key}, word string, times long, n_tokens long, lp double")
    if vocab.rest is None:
        out = out.withColumn("n", F.lit(1))
    else:
        out = out.join(vocab.rest, "word", "left")
    lp = F.col("lp") + F.col("times") * F.log(F.coalesce("n", F.lit(1)).cast("double"))
    out = out.groupBy("_row").agg(F.first("_id", ignorenulls=True).alias("_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(lp).alias("log_probability"))
    return out.select(F.col("_id").alias(id_col), *beside(id_col, "n_tokens", "log_probability"))


__all__ = ["Network", "Vocabulary", "encode", "padded_row", "score", "train", "word_counts"]
