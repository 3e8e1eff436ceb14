"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words and word beginnings, each as met and as met again, is trained in numpy from texts confirmed toxic and
unlabelled texts, whose toxic share (the class prior) corrects the risk: with losses lp, ln of calling a text clean or
toxic, the risk is prior * E_pos[lp] + max(0, E_unl[ln] - prior * E_pos[ln]); where the second term would be below
zero only the first gives the step.

The features are chosen with a bounded sample of unlabelled texts beside the toxic ones; E_unl is then the mean over all
texts. A text enters it by which of the chosen features it has, so texts are counted by that pattern in the cluster, and
each step weighs the patterns with their counts: on the driver while they are few, else in a job over their table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import beside, cut, sample_ids, tune

BUCKETS = 1 << 20
WORD = re.compile(r"[^\W_]+")
#: Confirmed toxic rows that the model is fitted on, at most, and texts, at most, that features are chosen with beside them.
FIT_POSITIVE, FIT_UNLABELLED = 3000, 6000
#: Patterns that the driver holds at most, and that a task counts before it hands its counts on.
PATTERNS, COUNTED = 1 << 15, 50_000
#: Features that the model weighs, those with the strongest evidence.
KEPT = 4096
#: Standard errors of evidence, and the ratio of shares in toxic and clean texts, that a feature needs.
EVIDENCE, RATIO = 4.5, 2.0
#: A toxic text that so many features mark asks for no further ones; and their number at most.
COVER, MOST = 4, 512
L1 = 0.02
#: Keeps steps small where the gradient is.
DAMP = 2e-3
#: Words whose features a worker remembers.
MEMORY = 300_000


def word_features(word: str) -> list[int]:
    """Buckets of a lower-cased word: itself and its beginnings of 3 to 6 letters. The odd number after each is free."""
    out = [crc32(b"w" + word.encode("utf-8", "surrogatepass")) & (BUCKETS - 2)]
    for n in (3, 4, 5, 6):
        if len(word) > n:
            out.append(crc32(b"p" + word[:n].encode("utf-8", "surrogatepass")) & (BUCKETS - 2))
    return out


def features(text: str) -> np.ndarray:
    """Distinct buckets of a whole text; of those met more than once also the odd number after."""
    met: Counter = Counter()
    for w, n in Counter(WORD.findall(text.lower())).items():
        for x in word_features(w):
            met[x] += n
    return np.array(sorted([*met, *(x + 1 for x, n in met.items() if n > 1)]), dtype=np.int32)


def matcher(wanted: dict[int, int]) -> Callable[[str], list[int]]:
    """A function from text to the numbers of the wanted buckets that it has, ascending by bucket; it remembers words."""
    known: dict[str, tuple[int, ...]] = {}

    def match(text: str) -> list[int]:
        if len(known) > MEMORY:
            known.clear()
        met: dict[int, int] = {}
        for w, n in Counter(WORD.findall(text.lower())).items():
            f = known.get(w)
            if f is None:
                f = known[w] = tuple(x for x in word_features(w) if x in wanted or x + 1 in wanted)
            for x in f:
                met[x] = met.get(x, 0) + n
        out = []
        for x in sorted(met):
            if x in wanted:
                out.append(wanted[x])
            if met[x] > 1 and x + 1 in wanted:
                out.append(wanted[x + 1])
        return out

    return match


@dataclass
class Model:
    weight: dict[int, float]  # by bucket
    bias: float

    def scorer(self) -> Callable[[str], float]:
        """A function from text to score."""
        weights = list(self.weight.values())
        match = matcher({x: i for i, x in enumerate(self.weight)})

        def score(text: str) -> float:
            z = self.bias + sum(weights[i] for i in match(text))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def choose(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> np.ndarray:
    """The buckets that the model weighs."""

    def frequency(bags: list[np.ndarray]) -> np.ndarray:
        return np.bincount(np.concatenate(bags), minlength=BUCKETS) / len(bags) if sum(map(len, bags)) else np.zeros(BUCKETS)

    fp, fu = frequency(positive), frequency(unlabelled)
    n_p, n_n = len(positive), (1 - prior) * len(unlabelled)
    fn = np.maximum(0, (fu - prior * fp) / (1 - prior))  # among clean texts
    # evidence: how far the share among toxic texts lies above that among clean ones, in standard errors, both smoothed
    sp, sn = (fp * n_p + 0.5) / (n_p + 1), (fn * n_n + 0.5) / (n_n + 1)
    mean = (sp * n_p + sn * n_n) / (n_p + n_n)
    gain = (sp - sn) / np.sqrt(mean * (1 - mean) * (1 / n_p + 1 / n_n))
    gain[(fp * n_p < 3) | (sp < RATIO * sn)] = 0
    kept = np.argsort(-gain, kind="stable")[:KEPT]
    kept = kept[gain[kept] > EVIDENCE]
    if not len(kept):
        return kept
    xp = dense(positive, kept)
    # many features say the same, which would share one weight among them: take the strongest in turn, and only while
    # there are toxic texts that few taken features mark
    marked, open_, taken = np.zeros(len(xp), dtype=np.int64), np.ones(len(kept), dtype=bool), []
    clean_share = (fn[kept] * n_n + 0.5) / (n_n + 1)
    while len(taken) < MOST:
        counts = xp[marked < COVER].sum(axis=0)
        worth = np.where(open_ & (counts >= 3), counts * np.log((sp[kept] / clean_share)), 0)
        best = int(worth.argmax())
        if worth[best] <= 0:
            break
        taken.append(best)
        open_[best] = False
        marked += xp[:, best] > 0
    return kept[taken]


def dense(bags: list[np.ndarray], kept: np.ndarray) -> np.ndarray:
    """Which of the kept buckets each bag holds."""
    slot = np.full(BUCKETS, -1, dtype=np.int64)
    slot[kept] = np.arange(len(kept))
    x = np.zeros((len(bags), len(kept)), dtype=np.float32)
    for i, b in enumerate(bags):
        s = slot[b]
        x[i, s[s >= 0]] = 1
    return x


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def moments(x: np.ndarray, n: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """Sums over texts (n of each pattern x) of the loss of calling them toxic and of its gradient by weights and bias."""
    z = x @ w + b
    g = n * sigmoid(z)
    return np.concatenate(([n @ np.logaddexp(0, z)], x.T @ g, [g.sum()]))


def unpacked(patterns: list[bytes], width: int) -> np.ndarray:
    bits = np.frombuffer(b"".join(patterns), dtype=np.uint8).reshape(len(patterns), -1)
    return np.unpackbits(bits, axis=1, count=width).astype(np.float32)


class Patterns:
    """All unlabelled texts, as counts of patterns of the kept features in a table (pattern, n)."""

    def __init__(self, table: DataFrame, width: int):
        self.table, self.width = table, width
        size = table.agg(F.count("*").alias("patterns"), F.sum("n").alias("texts")).first()
        self.texts, self.held = size.texts or 0, None
        if size.patterns <= PATTERNS:
            got = table.toArrow().sort_by("pattern")
            self.held = unpacked(got.column("pattern").to_pylist(), width), np.array(got.column("n").to_pylist(), dtype=np.float64)

    def __call__(self, w: np.ndarray, b: float) -> np.ndarray:
        """Mean loss of calling the texts toxic, and its gradient."""
        if self.held is not None:
            return moments(*self.held, w, b) / self.texts
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width + 2)
            for batch in batches:
                if batch.num_rows:
                    total += moments(unpacked(batch.column(0).to_pylist(), width), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64), w, b)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 2)), pa.array(total)], names=["i", "x"])

        sums = self.table.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow().sort_by("i")
        return np.array(sums.column("x").to_pylist()) / self.texts


def descend(kept: np.ndarray, xp: np.ndarray, clean: Callable[[np.ndarray, float], np.ndarray], prior: float, steps: int = 400) -> Model:
    """Minimise the risk; xp: the toxic texts' features, clean: mean loss and gradient of calling all texts toxic."""
    w = np.zeros(len(kept), dtype=np.float64)
    b = float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):  # whole-batch steps: the estimator's sign is then not a batch's accident
        zp, loss = xp @ w + b, clean(w, b)
        # logistic losses: lp = log(1 + e^-z), ln = log(1 + e^z)
        gp = prior * (sigmoid(zp) - 1) / len(zp)
        whole = loss[0] - prior * np.logaddexp(0, zp).mean() >= 0
        if whole:
            gp = gp - prior * sigmoid(zp) / len(zp)
        g = xp.T @ gp + (loss[1:-1] if whole else 0.0)
        gb = float(gp.sum() + loss[-1]) if whole else 0.0  # a bias that only positives move would creep on
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v) + DAMP)
        b -= float(rate * mb / (np.sqrt(vb) + DAMP))
        w = np.sign(w) * np.maximum(np.abs(w) - L1 * 0.05, 0)  # what carries no evidence goes to zero
    return Model({int(k): float(x) for k, x in zip(kept, w) if abs(x) > 1e-4}, b)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400) -> Model:
    """Train on the buckets of positive and unlabelled texts. Without positives every score is near zero."""
    if not positive or not unlabelled:
        return Model({}, -8.0 if not positive else 0.0)
    prior = float(np.clip(prior, 1e-3, 0.9))
    kept = choose(positive, unlabelled, prior)
    if not len(kept):
        return Model({}, float(np.log(prior / (1 - prior))))
    xu, one = dense(unlabelled, kept), np.ones(len(unlabelled))
    return descend(kept, dense(positive, kept), lambda w, b: moments(xu, one, w, b) / len(xu), prior, steps)


def pattern_counts(df: DataFrame, kept: np.ndarray, text_col: str = "text") -> DataFrame:
    """Rows (pattern binary, n): how many texts have which of the kept features; counted in the tasks before a shuffle."""
    width = len(kept)
    wanted = {int(k): i for i, k in enumerate(kept)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, counts = matcher(wanted), Counter()

        def out() -> pa.RecordBatch:
            patterns = np.zeros((len(counts), width), dtype=np.uint8)
            for i, p in enumerate(counts):
                patterns[i, list(p)] = 1
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.packbits(patterns, axis=1)], pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts[tuple(match(t or ""))] += 1
            if len(counts) > COUNTED:
                yield out()
                counts.clear()
        yield out()

    found = df.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "pattern binary, n long")
    return found.groupBy("pattern").agg(F.sum("n").alias("n"))


def _bags(df: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> list[np.ndarray]:
    """Features of the rows of df whose id is among ids (a bounded number), in the order of their ids."""
    chosen = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    chosen = chosen.join(F.broadcast(ids), F.col("_id") == F.col("_pick"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["_id", "at"])

    key = df.schema[id_col].dataType.simpleString()
    got = chosen.mapInArrow(run, schema=f"_id {key}, at array<int>").toArrow().sort_by("_id")
    return [np.asarray(a.values) for a in got.column("at")]


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    positives: int = FIT_POSITIVE,
    unlabelled: int = FIT_UNLABELLED,
    prior: float | None = None,
) -> Model:
    """Fit on confirmed toxic rows of labels (label 1), at most `positives`, and all rows of docs.

    Both inputs hold only rows that may be learned from; the toxic rows, and `unlabelled` rows that features are chosen
    with beside them, are chosen by a hash of their ids. The class prior is the toxic share of the labels if it isn't
    given. Labels with a null id or label are left out, null texts are empty.
    """
    tune(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if prior is None:
        share = known.agg(F.avg((F.col(label_col) == 1).cast("double")).alias("p")).first().p
        prior = share if share is not None else 0.1
    pick = lambda d, n: sample_ids(d.select(F.col(id_col).alias("_pick")).distinct(), "_pick", n)
    pos = _bags(docs, pick(known.where(F.col(label_col) == 1), positives), id_col, text_col)
    unl = _bags(docs, pick(docs.where(F.col(id_col).isNotNull()), unlabelled), id_col, text_col)
    if not pos or not unl:
        return fit(pos, unl, prior)
    prior = float(np.clip(prior, 1e-3, 0.9))
    kept = choose(pos, unl, prior)
    if not len(kept):
        return fit(pos, unl, prior)
    return descend(kept, dense(pos, kept), Patterns(cut(pattern_counts(docs, kept, text_col)), len(kept)), prior)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, score), one per row of df; whole texts, no shuffle, other columns unread.

    Null texts count as empty; an empty text's score is that of the model's bias. Ids are passed through;
    where id_col is named score, the scores are in _score.
    """
    tune(df.sparkSession)
    key = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t or "") for t in batch.column(1).to_pylist()], pa.float64())], names=["_id", "score"])

    named = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return named.mapInArrow(run, schema=f"_id {key.simpleString()}, score double").select(F.col("_id").alias(id_col), *beside(id_col, "score"))
