"""Interval operators: active at a time, last started, union, overlap, focus and fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuesheet.constants import LOOKAHEAD_SECONDS
from cuesheet.functions.fill import word_fill_at
from cuesheet.plans.ranges import overlap_join, stab_join
from cuesheet.plans.scan import Running, cut_groups, running, with_block


def display_time(audio_time):
    return F.greatest(F.lit(0.0), audio_time + LOOKAHEAD_SECONDS)


def indexed(
    intervals: DataFrame, tie: str, keys: tuple = ("track_id",), block_seconds: float = 600.0
) -> DataFrame:
    """Position of each interval by (start, end) and the largest end up to it."""
    keys = list(keys)
    blocked = with_block(intervals, F.col("start"), block_seconds)
    return running(
        blocked, keys, ["start", "end", tie],
        [
            Running("idx", "count", F.lit(1).cast("long"), False),
            Running("prefix_max_end", "max", F.col("end")),
        ],
    )


def active_at(intervals: DataFrame, points: DataFrame, bucket_seconds: float) -> DataFrame:
    """Every (point, interval) with start <= t < end."""
    return stab_join(intervals, points, ["track_id"], "start", "end", "t", bucket_seconds)


def last_started(
    intervals: DataFrame, points: DataFrame, tie: str, block_seconds: float = 600.0
) -> DataFrame:
    """As-of look-up: index and ``tie`` of the last interval with start <= t, -1 if none.

    Points and interval starts are one ordered stream; the index is the running number of
    starts, so no pair of the two sides is ever formed.
    """
    starts = intervals.select(
        "track_id", F.col("start").alias("t"), F.lit(0).alias("_tag"),
        F.col("end").alias("_end"), F.col(tie).alias("_tie"),
        *[F.lit(None).cast(points.schema[c].dataType).alias(c)
          for c in points.columns if c not in ("track_id", "t")],
    )
    probes = points.select(
        "track_id", "t", F.lit(1).alias("_tag"), F.lit(0.0).alias("_end"),
        F.lit(None).cast(intervals.schema[tie].dataType).alias("_tie"),
        *[c for c in points.columns if c not in ("track_id", "t")],
    )
    stream = with_block(starts.unionByName(probes), F.col("t"), block_seconds)
    scanned = running(
        stream, ["track_id"], ["t", "_tag", "_end", "_tie"],
        [
            Running("_count", "count", (F.col("_tag") == 0).cast("long")),
            Running("_last", "last", F.col("_tie")),
        ],
    )
    return scanned.filter(F.col("_tag") == 1).select(
        *points.columns, (F.col("_count") - 1).alias("idx"), F.col("_last").alias(tie)
    )


def merge_intervals(
    intervals: DataFrame, tie: str, block_seconds: float = 600.0
) -> DataFrame:
    """Union of intervals: joined when a start is at or before the largest end so far."""
    blocked = with_block(intervals, F.col("start"), block_seconds)
    grouped = cut_groups(
        blocked, ["track_id"], ["start", "end", tie], ["start"],
        lambda before, row: row["start"] > before["end"], "run", running_max="end",
    )
    return grouped.groupBy("track_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.count(F.lit(1)).alias("members"),
    ).drop("run")


def nearby(
    phrases: DataFrame, lead_words: DataFrame, margin: float = 0.45, bucket_seconds: float = 10.0
) -> DataFrame:
    """Phrases with every lead word within ``margin`` of their extent (closed bounds)."""
    return overlap_join(
        phrases, lead_words, ["track_id"],
        (F.col("start") - margin, F.col("end") + margin),
        (F.col("start"), F.col("end")), bucket_seconds,
    )


def focus_line(
    words: DataFrame, lines: DataFrame, points: DataFrame, bucket_seconds: float = 10.0,
    block_seconds: float = 600.0,
) -> DataFrame:
    """Line in focus at each display time ``t``, -1 before the first line.

    ``words`` and ``lines`` are timelines with idx, kind and line_no. The first active word
    decides (lead words first), then the first live line (lead first), then the last started
    line. Candidates are reduced to a minimum, so no window over a hot time is needed.
    """
    asked = points.select("track_id", "t").distinct()

    def ranked(df: DataFrame, rank: int) -> DataFrame:
        return df.select(
            "track_id", "t",
            F.struct(
                F.lit(rank).alias("rank"),
                (F.col("kind") != "lead").alias("second"),
                F.col("idx"), F.col("line_no"),
            ).alias("choice"),
        )

    shape = ["track_id", "start", "end", "idx", "kind", "line_no"]
    by_word = ranked(active_at(words.select(*shape), asked, bucket_seconds), 0)
    by_line = ranked(active_at(lines.select(*shape), asked, bucket_seconds), 1)
    latest = last_started(lines.select(*shape), asked, "line_no", block_seconds).select(
        "track_id", "t", F.lit("lead").alias("kind"), "idx",
        F.coalesce("line_no", F.lit(-1)).alias("line_no"),
    )
    chosen = (
        by_word.unionByName(by_line)
        .unionByName(ranked(latest, 2))
        .groupBy("track_id", "t")
        .agg(F.min("choice").alias("choice"))
    )
    return chosen.select(
        "track_id", "t", F.col("choice.rank").alias("source"),
        F.col("choice.line_no").cast("long").alias("focus_line"),
    )


def fill_at(words: DataFrame, points: DataFrame, bucket_seconds: float = 10.0) -> DataFrame:
    """Visible share of each word active at each display time."""
    active = active_at(words, points, bucket_seconds)
    return active.withColumn(
        "fill", word_fill_at(F.col("start"), F.col("end"), F.col("timing"), F.col("t"))
    )
