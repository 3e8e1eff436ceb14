"""Shared helpers of the corpus operators: where to cut lineage, batch sizes, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.lineage import cut, shared_dir

#: Rows of one Arrow batch handed to Python. Texts may be long, so batches are small.
BATCH_ROWS = 256


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)
    except Exception:  # the setting is absent from older Spark versions
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """Connected components of an undirected graph as rows (node, root), root the least node reachable.

    Alternating large-star and small-star steps: the first hangs every node's greater neighbours, the second its
    smaller ones, under its least neighbour. That neighbour is a minimum which is combined before the shuffle, so no
    neighbour list is ever gathered into one task; the joins are plain equi-joins, which adaptive execution splits where
    a node is hot. Null nodes and self loops are ignored, repeated edges are harmless; only nodes of some edge are
    returned.
    """
    pairs = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    pairs = cut(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())

    def hung(under: DataFrame, x: DataFrame) -> DataFrame:
        both = under.unionAll(x).where("lo <> hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
        return cut(both.distinct())

    for _ in range(max_rounds):
        both = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(pairs.select("hi", "lo"))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = pairs.join(least, pairs.lo == least.u).select(F.col("m").alias("lo"), "hi")
        pairs = hung(least.select(F.col("m").alias("lo"), F.col("u").alias("hi")), large)
        least = cut(pairs.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"), F.count("*").alias("n")))
        if not least.where("n > 1").limit(1).count() and not least.join(least.select(F.col("u").alias("m")), "m", "left_semi").limit(1).count():
            break  # every node hangs under one node, which hangs under none
        small = pairs.join(least, pairs.hi == least.u).select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        pairs = hung(least.select(F.col("m").alias("lo"), F.col("u").alias("hi")), small)
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select("lo").distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(
        roots.select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    )


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until df has no such column (column names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def beside(id_col: str, *names: str) -> list:
    """Result columns that stand beside an id column; one of the id column's own name gets an underscore before it."""
    return [F.col(n).alias(f"_{n}" if n.lower() == id_col.lower() else n) for n in names]


def in_fold(column: str, modulus: int, *remainders: int):
    """Whether crc32 of the column as text leaves one of the remainders; null ids are in no fold."""
    return F.coalesce((F.crc32(F.col(column).cast("string")) % modulus).isin(*remainders), F.lit(False))


def sample_ids(ids: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, those of the least hash of the key: the same rows on every run."""
    return ids.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(n)
