"""Range joins as equi joins on time buckets.

Catalyst turns ``a.start <= b.t AND b.t < a.end`` into a nested loop within the equi key.
Cutting time into buckets gives it an equality to hash on, so a long track spreads over
tasks, and a bucket that is still hot is split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def bucket(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(float(width))).cast("long")


def _spread(df: DataFrame, first: Column, last: Column, width: float, name: str) -> DataFrame:
    low, high = bucket(first, width), bucket(last, width)
    return df.withColumn(name, F.explode(F.sequence(low, F.greatest(low, high))))


def stab_join(
    intervals: DataFrame,
    points: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    at: str,
    width: float,
) -> DataFrame:
    """Intervals active at each point: ``start <= at < end``.

    An interval lies in buckets of its own level, the first one whose width (``width``, then twice that, and so on) is
    no smaller than its length, so it has two buckets at most, however long it is. A point asks one bucket of
    each level that occurs in its key.

    Both joins are merges: either side grows with the data, and adaptive execution would judge it by its compressed
    size and gather it at the driver.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col(end) - F.col(start)) / F.lit(float(width)))).cast("int"))
    sized = intervals.filter(F.col(end) > F.col(start)).withColumn("_level", level)
    wide = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level"))
    cell = lambda value: F.floor(value / wide).cast("long")
    left = sized.withColumn("_bucket", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    levels = sized.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    right = (
        points.join(levels.hint("merge"), keys).withColumn("_level", F.explode("_levels"))
        .withColumn("_bucket", cell(F.col(at)))
    )
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "_level", "_bucket"]] + [
        F.col(f"l.{start}") <= F.col(f"r.{at}"),
        F.col(f"r.{at}") < F.col(f"l.{end}"),
    ]
    joined = right.alias("r").join(left.alias("l").hint("merge"), on)
    return joined.select(
        *[F.col(f"r.{c}") for c in points.columns],
        *[F.col(f"l.{c}") for c in intervals.columns if c not in keys],
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_range: tuple[Column, Column],
    right_range: tuple[Column, Column],
    width: float,
) -> DataFrame:
    """Closed-interval overlap pairs, each once: in the later of the two first buckets."""
    l = left.withColumn("_lo", left_range[0]).withColumn("_hi", left_range[1])
    r = right.withColumn("_lo", right_range[0]).withColumn("_hi", right_range[1])
    l = _spread(l, F.col("_lo"), F.col("_hi"), width, "_bucket").alias("l")
    r = _spread(r, F.col("_lo"), F.col("_hi"), width, "_bucket").alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [
        F.col("l._bucket") == F.col("r._bucket"),
        F.col("r._hi") >= F.col("l._lo"),
        F.col("r._lo") <= F.col("l._hi"),
        F.col("l._bucket")
        == F.greatest(bucket(F.col("l._lo"), width), bucket(F.col("r._lo"), width)),
    ]
    return l.join(r, on).select(
        *[F.col(f"l.{c}") for c in left.columns],
        *[F.col(f"r.{c}") for c in right.columns if c not in left.columns],
    )
