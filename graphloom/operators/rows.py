"""Operators on rows of any table: places and neighbours, sets, counts by kind, searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.lineage import cut


def place_within(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "place", start: int = 0) -> DataFrame:
    """df with each row's place among those of its keys, from `start` on; the order should be total."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + start).cast("long"))


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence, part: str = "_part") -> DataFrame:
    """df dealt out by ranges of (keys, order) and stored, with the range's number: a hot key spans several ranges."""
    cols = [F.col(c) if isinstance(c, str) else c for c in [*keys, *order]]
    return cut(cut(df).repartitionByRange(*cols).withColumn(part, F.spark_partition_id()))  # stored first, since ranges are sampled


def place_over_ranges(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "place", start: int = 0) -> DataFrame:
    """As place_within, but no task holds all rows of a key: places within a range, plus the key's rows in earlier ranges."""
    r = ranged(df, keys, order)
    sizes = r.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each key and range
    # only a range's first key can have begun before it, so at most one row a range is left
    before = sizes.withColumn("_before", earlier).where("_before is not null").select(F.col("_part").alias("_bp"), *[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], "_before")
    inside = place_within(r, ["_part", *keys], order, out, start)
    on = F.col("_part") == F.col("_bp")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_b{i}"))
    placed = inside.join(F.broadcast(before), on, "left").withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0)))
    return placed.select(*df.columns, out)


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, before: str = "predecessor", after: str = "successor") -> DataFrame:
    """df with the value of the row before and of the row after among those of its keys, null at the ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(before, F.lag(value).over(w)).withColumn(after, F.lead(value).over(w))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(side, n): how many rows are missing from the second table and how many it adds, repeats counted."""
    one = lambda x, y, side: x.exceptAll(y).agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return one(before, after, "missing").unionAll(one(after, before, "added"))


def one_of(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All rows of the tables, by name of column, one for each key."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.dropDuplicates(list(keys))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that both tables hold."""
    return a.intersect(b)


def with_bits(df: DataFrame, column: str, bits: int) -> DataFrame:
    """Rows whose column has any of the bits."""
    return df.where(F.col(column).bitwiseAND(bits) != 0)


def pair_counts(df: DataFrame, a: str, b: str, flag: Column, yes: str, no: str) -> DataFrame:
    """(a, b, yes, no): pairs that occur both with the flag and without it, and how often."""
    n = df.groupBy(a, b).agg(F.count_if(flag).alias(yes), F.count_if(~flag).alias(no))
    return n.where((F.col(yes) > 0) & (F.col(no) > 0))


def by_kind(df: DataFrame, key: str, kind: str, kinds: dict[str, str]) -> DataFrame:
    """(key, one count for each kind, under the given names), zero where there is none."""
    p = df.groupBy(key).pivot(kind, list(kinds)).count()
    return p.select(key, *[F.coalesce(F.col(k), F.lit(0)).alias(n) for k, n in kinds.items()])


def distinct_per(df: DataFrame, key: str, value: str, out: str, least: int = 0) -> DataFrame:
    """(key, out): the number of distinct values of each key, if at least so many."""
    n = df.groupBy(key).agg(F.countDistinct(value).alias(out))
    return n.where(F.col(out) >= least) if least else n


def main_kind(df: DataFrame, column: str, share: float, other: str, out: str) -> DataFrame:
    """One row: the most frequent value, nulls aside, or `other` where it has less than a share of all rows."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    named = F.when(F.col(column).isNotNull(), F.col("n"))
    return n.agg(F.when(F.max(named) >= share * F.sum("n"), F.max_by(column, F.struct(named.alias("n"), F.col(column)))).otherwise(other).alias(out))


def subtotals(df: DataFrame, keys: Sequence[str], *totals: Column) -> DataFrame:
    """Totals of all prefixes of the keys, the rest of the keys null."""
    return df.rollup(*keys).agg(*totals)


def one_row(*tables: tuple[DataFrame, Sequence[Column]]) -> DataFrame:
    """The aggregates of several tables side by side in one row."""
    rows = [df.agg(*columns) for df, columns in tables]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def holding(df: DataFrame, text: str, columns: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """Rows one of whose columns holds the text, whatever its case, the first `most` in order."""
    return df.where(F.lower(F.concat_ws(" ", *columns)).contains(text.lower())).orderBy(*order).limit(most)
