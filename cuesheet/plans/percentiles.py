"""Exact percentiles per key without holding a key's values in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuesheet.plans.scan import BLOCK, Running, running


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]
) -> DataFrame:
    """Linear-interpolation percentiles of ``value`` per key.

    ``percentile`` keeps all distinct values of a key in one aggregation buffer, which a hot
    key overflows. Here equal values are counted before the shuffle, the counts are summed
    along the value axis in blocks, and the rows that hold the wanted ranks are picked out.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(BLOCK, F.floor(F.asinh(F.col("_v") * 1e6) * 16).cast("long"))
    )
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    placed = running(counts, keys, ["_v"], [Running("_upto", "sum", F.col("_n"))]).join(
        totals, keys
    )

    def at(rank):
        inside = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(inside, F.col("_v")))

    picks, results = [], []
    for name, share in wanted.items():
        place = (F.col("_total") - 1) * F.lit(float(share))
        picks += [
            at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"),
            F.max(place - F.floor(place)).alias(f"_w_{name}"),
        ]
        low, high, weight = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_w_{name}")
        results.append((low * (1.0 - weight) + high * weight).alias(name))
    return placed.groupBy(*keys).agg(*picks).select(*keys, *results)
