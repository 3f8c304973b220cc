"""Ordered folds over long keys, in chunks that carry a small state.

A fold whose state forgets, like "the last few kept rows", need not run from the start of its key. Each
chunk folds on a guess of the state before it; the state a chunk leaves is then compared with the guess of the chunk
after it, and only chunks whose entry changed fold again. It ends when no entry changes, and then every entry is
the true one: the first chunk's is known, and each other one is what its predecessor leaves. A state that forgets within a
chunk settles in one round after the first; one that never does takes as many rounds as chunks, and is still exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.plans.session import stage


def entry_states(
    chunks: DataFrame, keys: list[str], empty: Column,
    leave: Callable[[Column, Column], Column], enter: Callable[[Column, Column], Column],
) -> DataFrame:
    """(keys, chunk, entry): the state before each chunk of the stored table (keys, chunk, rows).

    ``leave(rows, entry)`` is the state after a chunk; ``enter(state, first)`` is what of it can still matter
    to a chunk whose first row is ``first``: the less it keeps, the fewer chunks fold again. Chunks are numbered
    from 0 without gaps.
    """
    at = [*keys, "chunk"]
    states = stage(chunks.select(
        *at, F.get("rows", F.lit(0)).alias("_first"), empty.alias("entry"), leave(F.col("rows"), empty).alias("_leave")
    ), "states")
    while True:
        before = states.select(*keys, (F.col("chunk") + 1).alias("chunk"), F.col("_leave").alias("_before"))
        entering = F.when(F.col("_before").isNull(), empty).otherwise(enter(F.col("_before"), F.col("_first")))
        moved = states.join(before, at, "left").withColumn("_entering", entering)
        changed = stage(
            moved.filter(~F.col("_entering").eqNullSafe(F.col("entry")))
            .select(*at, "_first", F.col("_entering").alias("entry")), "changed")
        if changed.isEmpty():
            return states.select(*at, "entry")
        again = chunks.join(changed.select(*at, "entry"), at).select(
            *at, F.get("rows", F.lit(0)).alias("_first"), "entry", leave(F.col("rows"), F.col("entry")).alias("_leave"))
        states = stage(states.join(changed, at, "left_anti").unionByName(again), "states")
