"""Words to lines: greedy grouping, line assembly, line numbering and word timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.constants import LINE_LEAD_IN, LINE_RULES, LINE_TAIL
from cuesheet.plans.scan import BLOCK, Running, numbered, running, with_block
from cuesheet.plans.segments import greedy_segments

SENTENCE_END = r"[.!?…]\n?$"
_LONGEST = max(rule[0] for rule in LINE_RULES.values())
_ORDER = ["start", "end", "word_no"]
_WORKING = ("pos", "track_id", "kind", "_most", "_longest", "_gap", "_ends")


def _rule(kind: Column, index: int) -> Column:
    return F.when(kind == "adlib", F.lit(LINE_RULES["adlib"][index])).otherwise(
        F.lit(LINE_RULES["lead"][index])
    )


def line_flags(words: DataFrame, block_seconds: float = 120.0) -> DataFrame:
    """Gap to the previous end, phrase change and sentence end, per (track, kind)."""
    stream = with_block(words, F.col("start"), block_seconds)
    row = F.struct("end", "phrase", "text")
    flagged = running(
        stream, ["track_id", "kind"], _ORDER, [Running("_before", "last", row, False)]
    )
    return flagged.select(
        *words.columns,
        (F.col("start") - F.col("_before.end")).alias("gap"),
        F.coalesce(F.col("phrase") != F.col("_before.phrase"), F.lit(False)).alias(
            "phrase_changed"
        ),
        F.coalesce(F.col("_before.text").rlike(SENTENCE_END), F.lit(False)).alias(
            "after_sentence"
        ),
    )


def group_lines(
    words: DataFrame, block_seconds: float = 120.0, chunk: int | None = None
) -> DataFrame:
    """One row per line with its words in order; not yet numbered.

    A line ends before a word that follows a long gap, exceeds the most words or the longest
    duration, follows a finished sentence of three words or more, or opens a new phrase after
    a pause or when the line is already long enough.
    """

    def certain(before: Column, row: Column) -> Column:
        gap = row["start"] - before["end"]
        return (gap > row["_gap"]) | ((row["phrase"] != before["phrase"]) & (gap > 0.06))

    def breaks(count: Column, first: Column, last: Column, row: Column) -> Column:
        gap = row["start"] - last["end"]
        length = row["end"] - first["start"]
        return (
            (gap > row["_gap"])
            | (count >= row["_most"])
            | (length > row["_longest"])
            | ((count >= 3) & last["_ends"])
            | (
                (row["phrase"] != last["phrase"])
                & ((gap > 0.06) | (count >= 4) | (length >= 2.5))
            )
        )

    words = words.withColumn("kind", F.coalesce("kind", F.lit("lead")))
    ruled = words.filter(F.col("kind").isin(*LINE_RULES)).select(
        "*", _rule(F.col("kind"), 0).alias("_most"), _rule(F.col("kind"), 1).alias("_longest"),
        _rule(F.col("kind"), 2).alias("_gap"), F.col("text").rlike(SENTENCE_END).alias("_ends"),
    )
    segments = greedy_segments(
        with_block(ruled, F.col("start"), block_seconds), ["track_id", "kind"], _ORDER,
        certain, breaks, _LONGEST, chunk, ["start", "end", "phrase", "_gap"],
    )
    return assemble_lines(segments.withColumnRenamed("rows", "words"))


def assemble_lines(lines: DataFrame) -> DataFrame:
    """Start of the first word, end of the *last* word (not the largest end)."""
    return lines.select(
        "track_id",
        "kind",
        F.element_at("words", 1)["start"].alias("start"),
        F.element_at("words", -1)["end"].alias("end"),
        F.element_at("words", 1)["word_no"].alias("first_word"),
        F.transform("words", lambda w: w.dropFields(*_WORKING)).alias("words"),
    )


def python_float(x: Column) -> Column:
    """A double as ``repr`` prints it: no exponent below 1e16."""
    plain = F.regexp_replace(x.cast("decimal(30,6)").cast("string"), "0+$", "")
    return F.when(F.abs(x) < 1e7, x.cast("string")).otherwise(
        F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    )


def number_lines(lines: DataFrame, block_seconds: float = 600.0, offsets: bool = False) -> DataFrame:
    """Line number and id by (start, lead first), numbered per track; with ``offsets`` also the number of words before
    each line, as ``line_word_offsets`` counts them, in the same scan."""
    ranked = with_block(lines, F.col("start"), block_seconds).withColumns({
        "_rank": (F.col("kind") != "lead").cast("int"),
        # lines that start together stand in the order of their first words
        "_first_end": F.element_at("words", 1)["end"],
    })
    order = ["start", "_rank", "_first_end", "first_word"]
    outputs = [Running("line_no", "count", F.lit(1).cast("long"), False)]
    if offsets:
        ranked = ranked.withColumn("_size", F.size("words").cast("long"))
        outputs.append(Running("word_offset", "sum", F.col("_size"), False))
    return running(ranked, ["track_id"], order, outputs).select(
        "track_id",
        "line_no",
        F.concat(
            F.lit("line-"), F.col("line_no").cast("string"), F.lit("-"), F.col("kind"),
            F.lit("-"), python_float(F.col("start")),
        ).alias("line_id"),
        "start", "end", "kind", "words", *[o.name for o in outputs[1:]],
    )


def words_to_lines(words: DataFrame, block_seconds: float = 120.0) -> DataFrame:
    return number_lines(group_lines(words, block_seconds))


def line_word_offsets(lines: DataFrame, lines_per_block: int = 4096) -> DataFrame:
    """Number of words before each line of its track."""
    sized = lines.withColumn("_size", F.size("words").cast("long"))
    blocked = with_block(sized, F.col("line_no"), lines_per_block)
    scanned = running(
        blocked, ["track_id"], ["line_no"], [Running("word_offset", "sum", F.col("_size"), False)]
    )
    return scanned.select(*lines.columns, "word_offset")


def word_timeline(lines: DataFrame, block_seconds: float = 120.0) -> DataFrame:
    """Words of numbered lines with line number, flat index and position by (start, end).

    Lines that ``number_lines`` gave their ``word_offset`` are not scanned for it again."""
    counted = lines if "word_offset" in lines.columns else line_word_offsets(lines)
    flat = counted.select(
        "track_id", "line_no", "word_offset", F.posexplode("words").alias("at", "word")
    )
    words = flat.select(
        "track_id",
        "line_no",
        (F.col("word_offset") + F.col("at")).alias("ref_no"),
        F.col("word.text").alias("text"),
        F.col("word.start").alias("start"),
        F.col("word.end").alias("end"),
    )
    blocked = with_block(words, F.col("start"), block_seconds)
    return numbered(blocked, ["track_id"], ["start", "end", "ref_no"], "idx").drop(BLOCK)


def line_timeline(lines: DataFrame, block_seconds: float = 600.0) -> DataFrame:
    """Lines with their lead-in and tail, positioned by (start, end)."""
    padded = lines.select(
        "track_id", "line_no", "kind",
        (F.col("start") - LINE_LEAD_IN).alias("start"),
        (F.col("end") + LINE_TAIL).alias("end"),
    )
    blocked = with_block(padded, F.col("start"), block_seconds)
    return numbered(blocked, ["track_id"], ["start", "end", "line_no"], "idx").drop(BLOCK)
