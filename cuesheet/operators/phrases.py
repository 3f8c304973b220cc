"""Text to phrases and timed words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cuesheet.constants import INTERJECTIONS
from cuesheet.functions.numeric import round_exact
from cuesheet.functions.text import normalize_for_interjection, piece_weight, pieces, strip_space


def tokenize(df: DataFrame, text: str, position: str = "pos", piece: str = "piece") -> DataFrame:
    """One row per piece of ``text``; other columns are kept."""
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.posexplode(pieces(F.col(text))).alias(position, piece))


def proportional_timings(
    df: DataFrame, phrase_keys: list[str], position: str, piece: str, start: Column, duration: Column
) -> DataFrame:
    """Share ``duration`` among the pieces of a phrase by letter count ** 0.72.

    The window is per phrase, that is per text value of one input row.
    """
    window = W.partitionBy(*phrase_keys)
    upto = window.orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    weighed = df.withColumn("_w", piece_weight(F.col(piece)))
    spread = weighed.select(
        "*",
        F.sum("_w").over(upto).alias("_cum"),
        F.coalesce(
            F.sum("_w").over(window.orderBy(position).rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0.0),
        ).alias("_prev"),
    ).withColumn("_total", F.max("_cum").over(window))
    safe = F.greatest(F.lit(0.04), duration.cast("double"))
    return (
        spread.withColumn("_from", start + safe * (F.col("_prev") / F.col("_total")))
        .withColumn("_to", start + safe * (F.col("_cum") / F.col("_total")))
        .withColumn("start", round_exact(F.col("_from")))
        .withColumn("end", round_exact(F.col("_to")))
        .drop("_w", "_cum", "_prev", "_total", "_from", "_to")
    )


def parenthetical_flags(df: DataFrame, phrase_keys: list[str], position: str, piece: str):
    """True from a piece that opens a bracket to the one that closes it."""
    window = W.partitionBy(*phrase_keys).orderBy(position)
    upto = window.rowsBetween(W.unboundedPreceding, -1)
    opens = F.col(piece).rlike(r"^[\"']?[(\[]")
    closes = F.col(piece).rlike(r"[)\]][^\p{L}\p{N}_]*$")
    after = F.when(closes, False).when(opens, True)
    return df.withColumn("_after", after).select(
        *df.columns,
        (opens | F.coalesce(F.last("_after", ignorenulls=True).over(upto), F.lit(False))).alias(
            "parenthetical"
        ),
    )


def interjection_ratio(piece_list: Column) -> Column:
    """Share of the non-empty a-z pieces that are interjections; null without pieces."""
    words = F.filter(F.transform(piece_list, normalize_for_interjection), lambda p: p != "")
    hits = F.size(F.filter(words, lambda p: p.isin(*INTERJECTIONS)))
    return F.when(F.size(words) > 0, hits / F.size(words))


def is_adlib_phrase(text: Column, piece_list: Column) -> Column:
    stripped = strip_space(text)
    wrapped = (stripped.startswith("(") & stripped.endswith(")")) | (
        stripped.startswith("[") & stripped.endswith("]")
    )
    words = F.filter(F.transform(piece_list, normalize_for_interjection), lambda p: p != "")
    few = F.size(words).between(1, 8)
    return wrapped | (few & F.coalesce(interjection_ratio(piece_list) >= 0.70, F.lit(False)))
