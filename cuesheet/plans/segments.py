"""Greedy segmentation of ordered rows, exact and free of unbounded groups.

A segment grows until ``breaks`` says the next row starts a new one; the decision may look at
the segment's size, its first row and its last row. That is a sequential fold per key, but two
facts make it parallel:

* some breaks are certain whatever the state (a long gap), so they cut independent islands;
* a segment has at most ``longest`` rows, so where an island has to be cut again the state at
  the cut is just "how many of the last rows are in the open segment", one of ``longest``
  values. Each piece turns into a small map from entry count to exit count; the maps are
  chained per island and every piece then folds on its own with a known entry count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.plans.scan import BLOCK, cut_groups

CHUNK = 4096


def _fold(rows: Column, first_own: Column, entry: Column, breaks) -> Column:
    """Fold rows from ``first_own`` on; struct(count, breaks = positions of segment starts).

    Positions are consecutive, so the rows of the open segment are the ``entry`` rows before.
    """
    place = (first_own - F.get(rows, F.lit(0))["pos"]).cast("int")
    opened = entry > 0
    zero = F.struct(
        entry.cast("int").alias("count"),
        F.get(rows, F.when(opened, place - entry).otherwise(-1).cast("int")).alias("first"),
        F.get(rows, F.when(opened, place - 1).otherwise(-1).cast("int")).alias("last"),
        F.array().cast("array<bigint>").alias("breaks"),
    )

    def step(acc: Column, row: Column) -> Column:
        new = (acc["count"] == 0) | breaks(acc["count"], acc["first"], acc["last"], row)
        return F.struct(
            F.when(new, 1).otherwise(acc["count"] + 1).alias("count"),
            F.when(new, row).otherwise(acc["first"]).alias("first"),
            row.alias("last"),
            F.when(new, F.array_append(acc["breaks"], row["pos"]))
            .otherwise(acc["breaks"]).alias("breaks"),
        )

    own = F.slice(rows, place + 1, F.size(rows))
    return F.aggregate(own, zero, step, lambda acc: F.struct(acc["count"], acc["breaks"]))


def _entry_counts(chunks: DataFrame, group: list[str], breaks, longest: int, chunk: int):
    """Rows in the open segment at the start of every chunk but the first of long islands."""
    first_own = F.col("chunk") * chunk
    stop = (first_own + chunk - F.element_at("rows", 1)["pos"]).cast("int")

    def leave(count: Column) -> Column:
        return _fold(F.col("own"), F.col("chunk") * chunk, count, breaks)["count"]

    counts = F.when(F.col("chunk") == 0, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(1), F.lit(longest))
    )
    maps = (
        chunks.filter(F.size("rows") >= stop)
        .withColumn("own", F.slice("rows", F.lit(1), stop))
        .select(*group, "chunk", F.transform(counts, leave).alias("leave"))
    )

    def chain(acc: Column, c: Column) -> Column:
        count = F.element_at(c["leave"], acc["count"])
        return F.struct(
            count.alias("count"),
            F.array_append(
                acc["entries"],
                F.struct((c["chunk"] + 1).alias("chunk"), count.alias("entry")),
            ).alias("entries"),
        )

    chained = maps.groupBy(*group).agg(
        F.aggregate(
            F.array_sort(F.collect_list(F.struct("chunk", "leave"))),
            F.struct(
                F.lit(1).alias("count"),
                F.array().cast("array<struct<chunk:bigint,entry:int>>").alias("entries"),
            ),
            chain,
            lambda acc: acc["entries"],
        ).alias("entries")
    )
    return chained.select(*group, F.inline("entries"))


def greedy_segments(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    certain,
    breaks,
    longest: int,
    chunk: int | None = None,
    looks_at: list[str] | None = None,
) -> DataFrame:
    """One row per segment: ``keys`` and ``rows``, the segment's rows in order.

    ``df`` carries a block column. ``certain(before, row)`` must imply ``breaks`` and reads
    the columns ``looks_at``; ``breaks`` gets (count, first row, last row, row), and must break once ``count`` is ``longest``.
    """
    chunk = max(chunk or CHUNK, longest)
    payload = [c for c in df.columns if c not in keys and c != BLOCK]
    islands = cut_groups(df, keys, order, looks_at or payload, certain, "_island")
    own = F.floor(F.col("_island_pos") / chunk)
    offset = F.col("_island_pos") % chunk
    placed = islands.withColumn(
        "chunk",
        F.explode(
            F.array_compact(
                F.array(
                    own,
                    F.when(offset >= chunk - longest, own + 1),
                    F.when((offset < longest - 1) & (own > 0), own - 1),
                )
            )
        ),
    )
    row = F.struct(F.col("_island_pos").alias("pos"), *[F.col(c) for c in [*keys, *payload]])
    group = [*keys, "_island"]
    chunks = placed.groupBy(*group, "chunk").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    entries = _entry_counts(chunks, group, breaks, longest, chunk)

    first_own = F.col("chunk") * chunk
    # An entry is a few numbers for each chunk of a long island, a ``chunk``-th of the rows at most: sent to all tasks, so
    # that the chunks are not shuffled again. The struct equals another one also where it holds nulls; a join on
    # the columns would filter nulls in one of the two readers of the chunks, and each would shuffle all rows.
    whole = F.struct(*group, "chunk").alias("_whole")
    known = F.broadcast(entries.select(whole, "entry"))
    folded = chunks.withColumn("_whole", whole).join(known, "_whole", "left").select(
        *keys,
        "rows",
        (first_own + chunk).alias("_stop"),
        F.element_at("rows", 1)["pos"].alias("_base"),
        _fold(F.col("rows"), first_own, F.coalesce("entry", F.lit(0)), breaks)["breaks"].alias(
            "_breaks"
        ),
    )
    spans = folded.select(
        *keys,
        "rows",
        "_base",
        F.explode(
            F.transform(
                F.filter("_breaks", lambda b: b < F.col("_stop")),
                lambda b, i: F.struct(b.alias("from"), F.get(F.col("_breaks"), i + 1).alias("to")),
            )
        ).alias("_span"),
    )
    begin = (F.col("_span.from") - F.col("_base") + 1).cast("int")
    length = F.coalesce(
        (F.col("_span.to") - F.col("_span.from")).cast("int"), F.size("rows") - begin + 1
    )
    return spans.select(*keys, F.slice("rows", begin, length).alias("rows"))
