"""Exact top-k search by inner product over an impact-ordered index, score at a time.

A block of vectors is indexed by dimension and quantised component: a posting segment holds the vectors whose component
lies in one range. For a query the segments are processed by descending impact on the score, i.e. by their distance from
the least the dimension can add, and every vector's processed postings are summed up at their segments' lower bounds. A
vector's score is at most its sum plus the width of each segment it was met in, plus what the next segments can add in
the other dimensions. Once few vectors can still reach the k-th best lower bound (of this block, or an exact score that
k vectors of earlier blocks reach), which proves that no other is a member, those few are scored exactly, in whole
numbers. Bounds are floating-point sums; where they may be rounded, the proof leaves more room than the rounding takes.

Candidates are packed into blocks and queries written to the shared folder once; a task indexes each of its blocks once
and reads all queries past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import beside, fresh_path

#: Vectors of one index, and queries that are read at once.
BLOCK_ROWS = 16384
QUERY_BLOCK = 1024
#: Queries, at most, whose best scores a task carries from one of its blocks to the next.
CARRIED = 1 << 17
LEVELS = 64
#: Shares of the postings after which the proof is tried, and the members per result that end the search early.
STAGES = (0.25, 0.5, 0.7, 0.85, 1.0)
FEW = 8


class ImpactIndex:
    """Posting segments of one block; x: whole numbers, a row per vector."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        n, dims = x.shape
        lo, hi = x.min(axis=0), x.max(axis=0)
        self.high = np.maximum(np.abs(lo.astype(np.float64)), np.abs(hi.astype(np.float64)))
        step = np.maximum(1, -((lo - hi - 1) // LEVELS))
        self.level = ((x - lo) // step).astype(np.int64)
        by_level = np.argsort(self.level, axis=0, kind="stable")
        key = np.take_along_axis(self.level, by_level, axis=0) + np.arange(dims) * LEVELS
        key = key.T.ravel()
        self.rows = by_level.T.ravel().astype(np.int32)  # postings in the order of (dimension, level)
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        self.size = np.diff(np.append(begins, len(key)))
        self.begin = begins.tolist()
        self.end = (begins + self.size).tolist()
        self.key = key[begins]
        self.dim = self.key // LEVELS
        values = np.take_along_axis(x, by_level, axis=0).T.ravel()
        self.least, self.most = np.minimum.reduceat(values, begins), np.maximum.reduceat(values, begins)

    def search(self, q: np.ndarray, own: int, k: int, known: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors but `own`, by descending score, then id.

        known: a score that k other vectors are known to reach; vectors that can't reach it may be left out.
        """
        n, dims = self.x.shape
        q = np.zeros(dims, np.int64) + np.pad(q[:dims], (0, max(0, dims - len(q))))
        largest = float(self.high @ np.abs(q.astype(np.float64)))
        if largest >= 2.0**62:
            raise OverflowError("inner products beyond 64 bits")
        room = largest * dims * 2.0**-48 if largest >= 2.0**50 else 0.0  # more than all rounding of the sums below
        qd = q[self.dim]
        high, low = np.maximum(qd * self.least, qd * self.most), np.minimum(qd * self.least, qd * self.most)
        floor = np.full(dims, np.iinfo(np.int64).max)  # the least that a dimension adds
        np.minimum.at(floor, self.dim, low)
        impact, gain = high - floor[self.dim], (low - floor[self.dim]).astype(np.float64)
        order = np.argsort(-impact, kind="stable")
        done = np.cumsum(self.size[order])
        sums = np.zeros(n)  # what a vector's processed postings add above the floor, at least
        candidate = self.ids != own
        base, at = float(floor.sum()), 0
        for share in STAGES:
            to = int(np.searchsorted(done, share * done[-1], "left")) + 1
            segments = order[at:to]
            if len(segments):
                picked = np.concatenate([self.rows[self.begin[s] : self.end[s]] for s in segments.tolist()])
                sums += np.bincount(picked, np.repeat(gain[segments], self.size[segments]), minlength=n)
            at = to
            rest = order[at:]
            slack = np.zeros(dims, np.int64)  # of a processed posting
            np.maximum.at(slack, self.dim[order[:at]], (high - low)[order[:at]])
            open_ = np.zeros(dims, np.int64)  # of a dimension in which the vector is still to come
            np.maximum.at(open_, self.dim[rest], impact[rest])
            lower = base + sums
            theta = max(known, np.partition(lower[candidate], -k)[-k] - room) if candidate.sum() > k else known
            theta -= room
            members = np.flatnonzero(candidate & (lower + float(np.maximum(slack, open_).sum()) >= theta))
            if len(members) * 4 > n and len(rest):
                continue  # too many to look at one by one
            # a vector's own bound, from the segments that it was met in
            bound = np.repeat(open_.astype(np.float64), LEVELS)
            bound[self.key[order[:at]]] = (high - low)[order[:at]]
            most = lower[members] + bound[self.level[members] + np.arange(dims) * LEVELS].sum(axis=1)
            members = members[most >= theta]
            if len(members) <= FEW * k:
                break
        scores = self.x[members] @ q
        best = np.lexsort((self.ids[members], -scores))[:k]
        return self.ids[members][best], scores[best]


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """Rows (vid, v): floor(scale * x) of every component; vectors null or with a null, NaN or infinite one are left out."""
    v = F.col(vec_col)
    x = F.transform(v, lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long"))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vid"), whole.alias("v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length; shorter vectors end in zeros."""
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    out = np.zeros((len(size), int(size.max(initial=0))), dtype=np.int64)
    if len(size) and (size == size[0]).all():
        return flat[off[0] : off[-1]].reshape(out.shape).astype(np.int64)
    for i, (a, n) in enumerate(zip(off[:-1], size)):
        out[i, :n] = flat[a : a + n]
    return out


def _block(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of the rows."""
    table = pa.Table.from_batches(parts).combine_chunks()
    x = _matrix(table.column(1).chunk(0))
    return table.column(0).to_numpy(), x if x.shape[1] else np.zeros((len(x), 1), np.int64)


def exact_top_k(df: DataFrame, query_filter, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """Rows (query_id, rank, id_col, score): the k largest integer inner products of each query with other rows.

    query_filter is a condition on df. A query's own row, i.e. every row with its id, is no candidate of it. Ties go to
    the smaller id; fewer than k candidates are all returned. Vectors that are null or hold a null or non-finite
    component, and rows without id, take no part; a shorter vector counts as ending in zeros. Repeated rows are
    candidates each. Scores are exact 64-bit sums; vectors whose products could leave 62 bits end the query with an
    error. A result column of the name id_col is written with an underscore before it. Queries are written to the shared folder, and read past every block of candidates QUERY_BLOCK at a time.
    """
    spark = df.sparkSession
    candidates = quantised(df, id_col, vec_col, scale)
    queries = quantised(df.where(query_filter), id_col, vec_col, scale)

    folder = fresh_path(spark, "queries")
    queries.write.parquet(folder)
    schema = "query_id long, vid long, score long"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK_ROWS - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == BLOCK_ROWS:
                    yield _block(held)
                    held, rows = [], 0
        if rows:
            yield _block(held)

    def stored() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All queries, some at a time, always in the same order."""
        fs, root = pafs.FileSystem.from_uri(folder)
        for f in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".parquet")):
            with fs.open_input_file(f) as source:
                for part in pq.ParquetFile(source).iter_batches(QUERY_BLOCK, columns=["vid", "v"]):
                    if part.num_rows:
                        yield _block([part])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the best scores of earlier blocks of this task, by number of the query
        for ids, x in blocks(batches):
            index, number = ImpactIndex(ids, x), 0
            for qid, q in stored():
                out = [[], [], []]
                for i in range(len(qid)):
                    before = held[number] if number < len(held) else np.zeros(0, np.int64)
                    found, scores = index.search(q[i], int(qid[i]), k, float(before[-1]) if len(before) == k else -np.inf)
                    if number < CARRIED:
                        best = np.sort(np.concatenate((before, scores)))[::-1][:k]
                        held[number : number + 1] = [best]
                    number += 1
                    out[0].append(np.full(len(found), qid[i]))
                    out[1].append(found)
                    out[2].append(scores)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["query_id", "vid", "score"])

    found = candidates.mapInArrow(search, schema=schema)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vid"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked = ranked.withColumn("rank", F.col("rank").cast("int"))
    first, second, last = beside(id_col, "query_id", "rank", "score")
    return ranked.select(first, second, F.col("vid").alias(id_col), last)
