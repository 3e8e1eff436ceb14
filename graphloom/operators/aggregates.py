"""Grouped results: dependencies, summaries, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.lineage import cut
from graphloom.operators.rows import place_over_ranges


def dependencies(references: DataFrame, source: str = "source_symbol_id", target: str = "target_symbol_id", ref: str = "id", gather: bool = True) -> DataFrame:
    """(source, target, reference_ids sorted, reference_count); references without source are left out.

    Without gather the ids are not put into one row a pair, which a pair of very many references would outgrow.
    """
    r = references.where(F.col(source).isNotNull())
    if not gather:
        return r.groupBy(source, target).agg(F.count("*").alias("reference_count"))
    return r.groupBy(source, target).agg(F.sort_array(F.collect_list(ref)).alias("reference_ids"), F.count("*").alias("reference_count"))


def dense_ids(df: DataFrame, order: list, out: str = "id") -> DataFrame:
    """Ids 0, 1, ... in a total order.

    Rows are sorted by ranges over all tasks; a first pass counts each part, so no task holds all rows.
    """
    df = cut(df)  # the ranges are sampled first, which would compute the rows twice
    s = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = s.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return s.join(F.broadcast(before), "_p").withColumn(out, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def cyclomatic(statements: DataFrame, symbol: str = "symbol_id", kind: str = "kind") -> DataFrame:
    """1 + branches of each symbol; boolean operators count one each."""
    weight = F.when(F.col(kind).isin("if", "elif", "for", "while", "except", "and", "or", "ternary", "case", "comprehension_if"), 1).otherwise(0)
    return statements.groupBy(symbol).agg((1 + F.sum(weight)).cast("long").alias("complexity"))


def cc_rank(c: Column) -> Column:
    """A to F by complexity."""
    return F.when(c < 0, None).when(c <= 5, "A").when(c <= 10, "B").when(c <= 20, "C").when(c <= 30, "D").when(c <= 40, "E").otherwise("F")


def halstead(tokens: DataFrame, symbol: str, token: str) -> DataFrame:
    """(symbol, total, distinct, volume): volume = N * log2(n), 0 for a symbol without tokens."""
    out = tokens.where(F.col(token).isNotNull()).groupBy(symbol).agg(F.count("*").alias("total"), F.countDistinct(token).alias("distinct_tokens"))
    return out.withColumn("volume", F.col("total") * F.log2("distinct_tokens"))


def halstead_of(tokens: Column) -> tuple[Column, Column, Column]:
    """Total, distinct tokens and volume of an array of tokens, without a shuffle."""
    total, distinct = F.size(tokens).cast("long"), F.size(F.array_distinct(tokens)).cast("long")
    return total, distinct, F.when(total > 0, total * F.log2(distinct.cast("double"))).otherwise(0.0)


def maintainability(volume: Column, complexity: Column, loc: Column) -> Column:
    """0 to 100, truncated to a whole number; texts without lines or volume get 100."""
    raw = 171 - 5.2 * F.log(F.greatest(volume, F.lit(1.0))) - 0.23 * complexity - 16.2 * F.log(F.greatest(loc, F.lit(1)))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(raw * 100 / 171))).cast("int")


def line_count(text: Column) -> Column:
    """Newlines, and one more if the text doesn't end in one; empty text has none."""
    n = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(n + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def flag_groups(flags: DataFrame, by: str, size: int, order: list[str]) -> DataFrame:
    """Flags of each group in chunks of `size`: adds chunk, counted from 0 in the given order. A group may be of any size."""
    placed = place_over_ranges(flags, [by], order, "_place")
    return placed.withColumn("chunk", F.floor(F.col("_place") / size).cast("long")).drop("_place")
