"""Document quality by a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of its bytes. Learned filters slide over a chunk's bytes; a filter's
greatest response in the chunk is kept, and a small layer combines these into chunk features. Each feature's greatest
value over all chunks and its mean over them are combined into one probability. A filter is a table per tap from byte
to response, which is a convolution over one-hot bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from graphloom.llm.common import beside, free_name, sample_ids, tune

CHUNK, OVERLAP = 512, 64
TAPS, FILTERS, HIDDEN = 6, 24, 12
#: Labelled rows that the network is fitted on, at most, and the bytes of the longest text among them: the driver holds
#: the whole texts.
FIT_ROWS, FIT_BYTES = 2000, 1 << 18
#: Texts of one training step, which sees all of their chunks, and chunks whose responses are held at once.
STEP_ROWS, AT_ONCE = 32, 16
STEP = CHUNK - OVERLAP
GROUP_CHUNKS = 512


def chunks(data: bytes) -> Iterator[np.ndarray]:
    """Groups of chunks of the bytes, one chunk a row; the last ends with zeros. Empty bytes are one chunk of zeros."""
    n = max(1, -(-(len(data) - OVERLAP) // STEP))
    for at in range(0, n, GROUP_CHUNKS):
        m = min(GROUP_CHUNKS, n - at)
        span = (m - 1) * STEP + CHUNK
        b = np.frombuffer(data[at * STEP : at * STEP + span], dtype=np.uint8)
        b = np.pad(b, (0, span - len(b)))
        yield np.lib.stride_tricks.sliding_window_view(b, CHUNK)[::STEP]


@dataclass
class Network:
    taps: np.ndarray  # TAPS x 256 x FILTERS
    offset: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """Chunks x positions x filters, before the offset."""
        n = rows.shape[1] - TAPS + 1
        out = self.taps[0][rows[:, :n]]
        for j in range(1, TAPS):
            out += self.taps[j][rows[:, j : j + n]]
        return out

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """The filters' greatest responses in each chunk."""
        return np.maximum(0, np.concatenate([self.responses(rows[i : i + AT_ONCE]).max(axis=1) for i in range(0, len(rows), AT_ONCE)]) + self.offset)

    def greatest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The filters' greatest responses in each chunk, before the offset, and where they are."""
        top, where = [], []
        for i in range(0, len(rows), AT_ONCE):
            r = self.responses(rows[i : i + AT_ONCE])
            where.append(r.argmax(axis=1))
            top.append(np.take_along_axis(r, where[-1][:, None, :], axis=1)[:, 0])
        return np.concatenate(top), np.concatenate(where)

    def probability(self, text: str) -> float:
        most, total, n = np.zeros(HIDDEN), np.zeros(HIDDEN), 0
        for rows in chunks(text.encode("utf-8", "surrogatepass")):
            h = np.maximum(0, self.pooled(rows) @ self.w1 + self.b1)
            most = np.maximum(most, h.max(axis=0))
            total += h.sum(axis=0)
            n += len(h)
        z = np.concatenate([most, total / n]) @ self.w2 + self.b2
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 12, seed: int = 5) -> Network:
    """Train on all chunks of each labelled text. No texts: every probability is one half."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.3, (TAPS, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32),
        np.zeros(HIDDEN, np.float32), rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), 0.0,
    )
    if not texts:
        net.w2[:] = 0
        return net
    share = float(np.clip(labels.mean(), 0.02, 0.98))
    weigh = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))  # the rarer label counts more
    params = {"taps": net.taps, "offset": net.offset, "w1": net.w1, "b1": net.b1, "w2": net.w2, "b2": np.zeros(1, np.float32)}
    first = {k: np.zeros_like(p) for k, p in params.items()}
    second = {k: np.zeros_like(p) for k, p in params.items()}
    t = 0
    for epoch in range(epochs):
        rate0 = 0.02 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(texts))
        for at in range(0, len(order), STEP_ROWS):
            docs = order[at : at + STEP_ROWS]
            picks = [np.concatenate(list(chunks(texts[d]))) for d in docs]
            size = np.array([len(p) for p in picks])
            for i, d in enumerate(docs):  # short texts are rarer than they matter: some rows are cut short
                if rng.random() < 0.2:
                    at_least = 8 if labels[d] == 1 else 128
                    short = np.zeros((1, CHUNK), np.uint8)
                    n = int(at_least * (CHUNK / at_least) ** rng.random())
                    short[0, :n] = picks[i][rng.integers(len(picks[i]))][:n]
                    picks[i], size[i] = short, 1
            x = np.concatenate(picks)
            begins = np.concatenate(([0], np.cumsum(size)[:-1]))
            top, where = net.greatest(x)  # chunks x filters
            a0 = top + net.offset
            pool = np.maximum(0, a0)
            a1 = pool @ net.w1 + net.b1
            h = np.maximum(0, a1)
            most = np.maximum.reduceat(h, begins)
            mean = np.add.reduceat(h, begins) / size[:, None]
            feats = np.concatenate([most, mean], axis=1)
            z = feats @ net.w2 + params["b2"][0]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            gz = ((p - labels[docs]) * weigh[docs] / len(docs)).astype(np.float32)
            grads = {"w2": feats.T @ gz, "b2": np.array([gz.sum()], np.float32)}
            gf = gz[:, None] * net.w2[None]
            doc_of = np.repeat(np.arange(len(docs)), size)
            is_most = (h == most[doc_of]) & (h > 0)
            gh = gf[doc_of, HIDDEN:] / size[doc_of][:, None] + is_most * gf[doc_of, :HIDDEN]
            g1 = gh * (a1 > 0)
            grads["w1"], grads["b1"] = pool.T @ g1, g1.sum(axis=0)
            g0 = (g1 @ net.w1.T) * (a0 > 0)
            grads["offset"] = g0.sum(axis=0)
            gt = np.zeros_like(net.taps)
            i, f = np.nonzero(g0)
            pos = where[i, f]
            for j in range(TAPS):
                np.add.at(gt[j], (x[i, pos + j], f), g0[i, f])
            grads["taps"] = gt
            t += 1
            rate = rate0 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-7)).astype(np.float32)
    net.b2 = float(params["b2"][0])
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Network:
    """Fit on at most `rows` labelled rows, half of either label where there are enough, chosen by a hash of their ids.

    Both inputs hold only rows that may be learned from. Null ids and labels are left out, and so are chosen rows whose
    texts have over FIT_BYTES bytes; the others are learned from whole. Null texts are empty.
    """
    tune(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_pick"), F.col(label_col).cast("int").alias("_label"))
    known = known.groupBy("_pick").agg(F.max("_label").alias("_label"))
    good, bad = (sample_ids(known.where(f"_label = {v}"), "_pick", rows // 2) for v in (1, 0))
    picked = good.unionAll(bad)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    chosen = chosen.join(F.broadcast(picked), F.col("_id") == F.col("_pick")).where(F.coalesce(F.octet_length("_text"), F.lit(0)) <= FIT_BYTES)
    got = chosen.select("_id", "_text", "_label").toArrow().sort_by([("_id", "ascending"), ("_text", "ascending")])
    data = [(t or "").encode("utf-8", "surrogatepass") for t in got.column("_text").to_pylist()]
    return fit(data, np.array(got.column("_label").to_pylist(), dtype=np.float32))


def score(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", keep_as: str | None = None) -> DataFrame:
    """Rows (id_col, score), one per row of df; with keep_as, all columns of df and the score in one of that name.

    Whole texts, no shuffle; where id_col is named score, the scores are in _score. Null texts count as empty, whose score is that of a chunk of zeros. Ids are passed through.
    """
    tune(df.sparkSession)
    text = free_name(df, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([net.probability(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()], pa.float64())
            names = [*batch.schema.names[:-1], keep_as or "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=names)

    rest = df if keep_as else df.select(F.col(id_col).alias("_id"))
    columns = df.columns if keep_as else [F.col(id_col).alias("_id")]
    named = df.select(*columns, F.col(text_col).cast("string").alias(text))
    out = named.mapInArrow(run, schema=StructType([*rest.schema.fields, StructField(keep_as or "score", DoubleType())]))
    return out if keep_as else out.select(F.col("_id").alias(id_col), *beside(id_col, "score"))
