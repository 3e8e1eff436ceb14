"""Joins of the resolver: priority ladders, last-wins build sides, span containment and overlap, as-of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.rows import ranged


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: bool = False) -> DataFrame:
    """One row per key: that of the greatest order (least with first). An aggregate, so rows combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    best = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def ladder(probe: DataFrame, rungs: Sequence[tuple[DataFrame, Sequence[tuple[Column | str, str]], str]], out: str, rung: str | None = None) -> DataFrame:
    """Left joins in order of priority; out is the first rung's value that is found, rung its number from 1.

    Each rung is (build side, [(probe expression, build column)], value column). Build sides are made unique first:
    a repeated key would repeat probe rows.
    """
    df, hits = probe, []
    for i, (build, keys, value) in enumerate(rungs):
        names = [f"_k{i}_{j}" for j in range(len(keys))]
        side = build.select(*[F.col(b).alias(n) for (_, b), n in zip(keys, names)], F.col(value).alias(f"_v{i}"))
        side = side.where(F.col(f"_v{i}").isNotNull()).groupBy(*names).agg(F.max(f"_v{i}").alias(f"_v{i}"))
        cond = None
        for (p, _), n in zip(keys, names):
            one = (F.col(p) if isinstance(p, str) else p) == F.col(n)
            cond = one if cond is None else cond & one
        df = df.join(side, cond, "left").drop(*names)
        hits.append(f"_v{i}")
    df = df.withColumn(out, F.coalesce(*hits))
    if rung:
        step = None
        for i, h in enumerate(hits):
            step = F.when(F.col(h).isNotNull(), i + 1) if step is None else step.when(F.col(h).isNotNull(), i + 1)
        df = df.withColumn(rung, step)
    return df.drop(*hits)


def innermost(points: DataFrame, spans: DataFrame, group: str, start: str, end: str, span_id: str, out: str = "container", itself: bool = True) -> DataFrame:
    """For each row of points the id of the shortest span of its group that holds it, the least id on ties; else null.

    Without `itself` a span doesn't hold the point whose row is its id. points has a unique column `row`, and group, start and end as spans has. Equality on the group keeps it a hash or
    sort-merge join with a residual; only (row, id, length) goes through the aggregate.
    """
    s = spans.select(F.col(group).alias("_g"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(span_id).alias("_id"))
    hit = points.select("row", group, start, end).join(s, (F.col(group) == F.col("_g")) & (F.col("_s") <= F.col(start)) & (F.col(end) <= F.col("_e")))
    hit = hit if itself else hit.where("_id <> row")
    best = hit.groupBy("row").agg(F.min_by("_id", F.struct(F.col("_e") - F.col("_s"), F.col("_id"))).alias(out))
    return points.join(best, "row", "left")


def overlaps(a: DataFrame, b: DataFrame, group: str, a_span: tuple[str, str], b_span: tuple[str, str], how: str = "inner") -> DataFrame:
    """Rows of a and b of one group whose half-open spans overlap; b's columns must not clash with a's but the group."""
    b = b.withColumnRenamed(group, "_g")
    cond = (F.col(group) == F.col("_g")) & (F.col(a_span[0]) < F.col(b_span[1])) & (F.col(b_span[0]) < F.col(a_span[1]))
    return a.join(b, cond, how).drop("_g")


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, values: Sequence[str], strict: bool = True) -> DataFrame:
    """Each left row with the values of the latest right row of its keys before it (or at it, if not strict).

    One union and one window instead of an inequality join: the sort is linear in the rows, whatever the matches. Rows are
    dealt out by ranges of keys and time, so no task holds all rows of a key.
    Rows of equal `at` on the right: the greatest values win.
    """
    tag = 1 if strict else 0  # at equal times a left row precedes right ones if strict
    cols = [c for c in left.columns]
    l = left.select(*[F.col(c) for c in cols], F.lit(1 - tag).alias("_side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    r = right.select(
        *[F.col(c) if c in by or c == at else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.lit(tag).alias("_side"), F.struct(*values).alias("_v")
    )
    both = ranged(l.unionAll(r), by, [at, "_side", "_v"])
    w = Window.partitionBy("_part", *by).orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = (F.col("_side") == 1 - tag) & F.col("_v").isNull()
    # the last values of each key and range; what a range's first key brings from earlier ones is one row a range
    ends = both.groupBy("_part", *by).agg(F.max(F.when(F.col("_v").isNotNull(), F.struct(at, "_side", "_v"))).alias("_x"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.withColumn("_y", F.last("_x", ignorenulls=True).over(earlier)).where("_y is not null")
    brought = brought.select(F.col("_part").alias("_bp"), *[F.col(k).alias(f"_b{i}") for i, k in enumerate(by)], F.col("_y._v").alias("_brought"))
    on = F.col("_part") == F.col("_bp")
    for i, k in enumerate(by):
        on = on & F.col(k).eqNullSafe(F.col(f"_b{i}"))
    out = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where(own).join(F.broadcast(brought), on, "left")
    last = F.coalesce("_last", "_brought")
    return out.select(*cols, *[last[v].alias(f"prev_{v}") for v in values])


def unmatched(df: DataFrame, other: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows without a partner: left anti join on (own, other) column pairs."""
    side = other.select(*[F.col(o).alias(f"_o{i}") for i, (_, o) in enumerate(on)]).distinct()
    cond = None
    for i, (c, _) in enumerate(on):
        one = F.col(c) == F.col(f"_o{i}")
        cond = one if cond is None else cond & one
    return df.join(side, cond, "left_anti")


def matched(df: DataFrame, other: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows with a partner: left semi join on (own, other) column pairs."""
    side = other.select(*[F.col(o).alias(f"_o{i}") for i, (_, o) in enumerate(on)]).distinct()
    cond = None
    for i, (c, _) in enumerate(on):
        one = F.col(c) == F.col(f"_o{i}")
        cond = one if cond is None else cond & one
    return df.join(side, cond, "left_semi")
