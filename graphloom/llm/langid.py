"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Subwords are runs of two to four bytes of the lower-cased text, every run of other characters than letters taken as one
blank. Each is hashed to a row of the embedding table; a document is the mean of its subwords' rows, whole text
included. Scores are probabilities at a temperature fitted on rows the training didn't see, and a prediction is accepted
if its score reaches a threshold calibrated there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import beside, sample_ids, tune

BUCKETS = 1 << 15
DIM = 12
#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 3000
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
SLICE = 1 << 20
_LETTERS = np.full(256, 32, dtype=np.uint32)
for _b in (*range(97, 123), *range(128, 256)):
    _LETTERS[_b] = _b


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the subwords, some slices after another, so a text of any length takes bounded memory."""
    data = b" " + text.lower().encode("utf-8", "surrogatepass") + b" "
    for at in range(0, max(1, len(data) - 3), SLICE):
        b = _LETTERS[np.frombuffer(data, dtype=np.uint8, count=min(SLICE + 3, len(data) - at), offset=at)]
        keep = np.ones(len(b), dtype=bool)
        keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
        b = b[keep]
        n = len(b) - 3
        if n <= 0:
            yield np.zeros(0, np.int64)
            continue
        h2 = b[:n] * np.uint32(0x9E3779B1) + b[1 : n + 1] * np.uint32(0x85EBCA77)
        h3 = h2 + b[2 : n + 2] * np.uint32(0xC2B2AE3D)
        h4 = h3 + b[3 : n + 3] * np.uint32(0x27D4EB2F)
        for size, h in ((2, h2), (3, h3), (4, h4)):
            h = h ^ np.uint32(size * 0x165667B1 & 0xFFFFFFFF)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield ((h >> np.uint32(12)) & np.uint32(BUCKETS - 1)).astype(np.int64)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    counts = np.zeros(BUCKETS, dtype=np.float64)
    for s in subwords(text):
        counts += np.bincount(s, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / max(1.0, counts.sum())).astype(np.float32)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # embeddings times weights: what a bucket's share adds to each logit
    bias: np.ndarray
    temperature: float
    accept: float

    def scores(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.labels)), 0
        for s in subwords(text):
            counts = np.bincount(s, minlength=BUCKETS)
            total += counts @ self.table
            n += len(s)
        return softmax((total / max(1, n) + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 6, seed: int = 7) -> Model:
    """Train on bags and labels; a fifth of the rows is kept for calibration. One label or none gives a constant model."""
    names = sorted(set(labels))
    if len(names) < 2:
        return Model(names or [UNKNOWN], np.zeros((BUCKETS, max(1, len(names)))), np.zeros(max(1, len(names))), 1.0, 0.0)
    y = np.array([names.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.3, (DIM, len(names))).astype(np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    rows = rng.permutation(len(bags))
    held, train = rows[: len(rows) // 5], rows[len(rows) // 5 :]
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs)
        for r in rng.permutation(train):
            at, share = bags[r]
            if not len(at):
                continue
            x = share @ emb[at]
            g = softmax(x @ w + bias)
            g[y[r]] -= 1
            back = w @ g
            w -= rate * np.outer(x, g)
            bias -= rate * 0.1 * g
            emb[at] -= (rate * 20 * share)[:, None] * back
    table = (emb @ w).astype(np.float64)
    held = held if len(held) else train
    z = np.stack([bags[r][1] @ table[bags[r][0]] + bias for r in held])
    best = min((0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean())
    p = softmax(z / best)
    right = p.argmax(axis=1) == y[held]
    # the least score from which on at least 99 % of the held rows are right
    order = np.argsort(-p.max(axis=1))
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= 0.99
    accept = float(p.max(axis=1)[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return Model(names, table, bias.astype(np.float64), best, accept)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = FIT_ROWS) -> Model:
    """Fit on at most `rows` labelled rows of df, chosen by a hash of their ids. Null texts and labels are left out."""
    spark = df.sparkSession
    tune(spark)
    usable = df.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    ids = sample_ids(usable.select(F.col(id_col).alias("_pick")), "_pick", rows).distinct()
    chosen = usable.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(label_col).cast("string").alias("_label"))
    chosen = chosen.join(F.broadcast(ids), F.col("_id") == F.col("_pick"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([b[0] for b in bags], pa.list_(pa.int32())), pa.array([b[1] for b in bags], pa.list_(pa.float32()))],
                names=["_id", "label", "at", "share"],
            )

    key = df.schema[id_col].dataType.simpleString()
    got = chosen.mapInArrow(run, schema=f"_id {key}, label string, at array<int>, share array<float>").toArrow().sort_by([("_id", "ascending"), ("label", "ascending")])
    bags = [(np.asarray(a.values), np.asarray(s.values)) for a, s in zip(got.column("at"), got.column("share"))]
    return fit(bags, got.column("label").to_pylist())


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, lang_pred, score, accepted), one per row of df; whole texts, no shuffle, other columns unread.

    Null texts and texts without a letter are `und` with score 0 and not accepted. Any other text gets the likeliest
    learned label; accepted is false where its score is below the calibrated threshold. A result column of the name id_col
    is written with an underscore before it.
    """
    tune(df.sparkSession)
    key = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, score, ok = [], [], []
            for t in batch.column(1).to_pylist():
                if t is None or not LETTER.search(t):
                    label.append(UNKNOWN), score.append(0.0), ok.append(False)
                    continue
                p = model.scores(t)
                i = int(p.argmax())
                label.append(model.labels[i]), score.append(float(p[i])), ok.append(bool(p[i] >= model.accept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], names=["_id", "lang_pred", "score", "accepted"])

    named = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = named.mapInArrow(run, schema=f"_id {key.simpleString()}, lang_pred string, score double, accepted boolean")
    return out.select(F.col("_id").alias(id_col), *beside(id_col, "lang_pred", "score", "accepted"))
