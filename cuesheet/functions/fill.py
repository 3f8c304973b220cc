"""Visible share of a word at a display time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def word_fill_at(start: Column, end: Column, timing: Column, t: Column) -> Column:
    """0 before the word, 1 from its end on; landmarks in between.

    The landmarks are folded in end order. The accumulator keeps the last landmark, the
    fill reached there and, once a landmark at or after ``t`` is met, the answer.
    """
    units = F.array_sort(
        F.transform(
            F.filter(
                timing,
                lambda u: u["start"].isNotNull() & u["end"].isNotNull() & u["fill"].isNotNull()
                & (u["end"] > u["start"]),
            ),
            lambda u, i: F.struct(
                u["end"].alias("end"), i.alias("i"), u["start"].alias("start"),
                u["fill"].alias("fill"),
                F.coalesce(u["pause_before"], F.lit(False)).alias("pause"),
            ),
        )
    )

    def step(acc: Column, u: Column) -> Column:
        reach = F.greatest(acc["done"], F.least(F.lit(1.0), u["fill"]))
        mark = F.greatest(acc["time"] + 0.001, F.least(end, u["end"]))
        sweep = F.when(
            u["pause"], F.greatest(acc["time"], F.least(u["start"], mark) - 0.065)
        ).otherwise(acc["time"])
        share = F.greatest(
            F.lit(0.0),
            F.least(F.lit(1.0), (t - sweep) / F.greatest(F.lit(0.016), mark - sweep)),
        )
        eased = F.when(u["pause"], share * share * (3.0 - 2.0 * share)).otherwise(share)
        here = F.when(t <= sweep, acc["done"]).otherwise(
            acc["done"] + (reach - acc["done"]) * eased
        )
        answer = F.when(acc["answer"].isNull() & (t <= mark), here).otherwise(acc["answer"])
        return F.struct(mark.alias("time"), reach.alias("done"), answer.alias("answer"))

    zero = F.struct(
        start.cast("double").alias("time"),
        F.lit(0.0).alias("done"),
        F.lit(None).cast("double").alias("answer"),
    )
    swept = F.aggregate(units, zero, step, lambda acc: F.coalesce(acc["answer"], acc["done"]))
    linear = F.greatest(
        F.lit(0.0),
        F.least(F.lit(1.0), (t - start) / F.greatest(F.lit(0.05), end - start)),
    )
    return (
        F.when(t <= start, 0.0)
        .when(t >= end, 1.0)
        .when(F.coalesce(F.size(units), F.lit(0)) <= 0, linear)
        .otherwise(swept)
    )
