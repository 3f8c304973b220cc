"""Streams of words and playback positions."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, functions as F

from cuesheet.constants import LINE_RULES
from cuesheet.functions.text import normalize_for_dedup
from cuesheet.operators.cleaning import LOOK_BACK, with_defaults
from cuesheet.operators.intervals import active_at, display_time, focus_line
from cuesheet.operators.lines import SENTENCE_END
from cuesheet.streaming.ordered import in_event_order

#: Seconds before the first word: a stream's watermark starts at 0, and what is not after it counts as late.
BEFORE = 1.0


def media_timestamp(seconds):
    """Media time as a timestamp for watermarks, ``BEFORE`` later, so that a word at 0 is not late."""
    return F.timestamp_micros(F.rint((seconds + BEFORE) * 1e6).cast("long"))


def stream_lines(words: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Lines of every (track, kind), each once it is closed: the rows of ``group_lines``. Append mode.

    A key's state is its open line, at most twelve words, and the words newer than the watermark; a line ends
    with the word that breaks it, or when the watermark is past the longest gap after its last word.
    """
    columns = ["word_no", "text", "start", "end", "phrase"]
    lead = F.coalesce("kind", F.lit("lead"))
    rows = words.withColumn("kind", lead).filter(F.col("kind").isin(*LINE_RULES)).select(
        "track_id", "kind", media_timestamp(F.col("start")).alias("ts"), *columns, F.col("text").rlike(SENTENCE_END).alias("ends"))
    kinds = {c: words.schema[c].dataType.simpleString() for c in ("track_id", *columns)}
    word = ",".join(f"{c}:{kinds[c]}" for c in columns)
    out = f"track_id {kinds['track_id']}, kind string, start double, end double, first_word {kinds['word_no']}, words array<struct<{word}>>"
    no, _, start, end, phrase, ends = range(1, 7)

    def breaks(line: list[tuple], row: tuple, rule: tuple) -> bool:
        most, longest, widest = rule
        first, last = line[0], line[-1]
        gap, length = row[start] - last[end], row[end] - first[start]
        changed = row[phrase] is not None and last[phrase] is not None and row[phrase] != last[phrase]
        return bool(gap > widest or len(line) >= most or length > longest or (len(line) >= 3 and last[ends])
                    or (changed and (gap > 0.06 or len(line) >= 4 or length >= 2.5)))

    def fold(key: tuple, carried, due: list[tuple], watermark: int):
        track, kind = key
        rule = LINE_RULES[kind]
        line = [tuple(w) for w in carried[0]] if carried else []
        done = []

        def close() -> None:
            done.append((track, kind, line[0][start], line[-1][end], line[0][no], [tuple(w[1:6]) for w in line]))

        for row in due:
            if line and breaks(line, row, rule):
                close()
                line = []
            line.append(row)
        if not line:
            return done, None, None
        last = ceil((line[-1][end] + rule[2] + BEFORE) * 1000) + 1
        if watermark >= last:
            close()
            return done, None, None
        return done, (line,), last

    carried = f"line array<struct<at:bigint,{word},ends:boolean>>"
    return in_event_order(rows, ["track_id", "kind"], ["start", "end", "word_no"], delay, carried, out, fold)


def stream_dedup(words: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Words without the repeats that ``deduplicate_words`` drops, each once no later word can repeat it. Append mode.

    A track's state is its last twelve kept words, as far as they are recent, and the words newer than the watermark.
    """
    given = with_defaults(words)
    named = given.withColumn("norm", normalize_for_dedup(F.col("text"))).filter(F.col("norm") != "")
    columns = [c for c in words.columns if c != "track_id"]
    rows = named.select(
        "track_id", media_timestamp(F.col("start")).alias("ts"), "norm", (F.col("kind") != "lead").cast("int").alias("rank"), *columns)
    kinds = {c: words.schema[c].dataType.simpleString() for c in words.columns}
    out = ",".join(f"{c} {kinds[c]}" for c in words.columns)
    payload = ",".join(f"{c}:{kinds[c]}" for c in columns)
    place = {c: n for n, c in enumerate(["at", "norm", "rank", *columns])}
    start, end, kind, phrase = (place[c] for c in ("start", "end", "kind", "phrase"))
    given_order = [columns.index(c) if c != "track_id" else -1 for c in words.columns]

    def repeats(kept: tuple, row: tuple) -> bool:
        distance = abs(row[start] - kept[start])
        overlaps = min(row[end], kept[end]) > max(row[start], kept[start])
        apart = row[phrase] < 0 or kept[phrase] < 0 or row[phrase] != kept[phrase]
        return kept[1] == row[1] and kept[kind] == row[kind] and apart and distance < 0.7 and (overlaps or distance < 0.16)

    def fold(key: tuple, carried, due: list[tuple], watermark: int):
        recent = [tuple(w) for w in carried[0]] if carried else []
        settled = []
        for row in due:
            hit = next((n for n in range(len(recent) - 1, -1, -1) if repeats(recent[n], row)), None)
            if hit is None:
                recent.append(row)
                if len(recent) > LOOK_BACK:
                    settled.append(recent.pop(0))
            else:
                known = list(recent[hit])
                known[end] = max(known[end], row[end])
                recent[hit] = tuple(known)
        # later words start behind the watermark
        while recent and recent[0][start] + 0.701 + BEFORE <= watermark / 1000:
            settled.append(recent.pop(0))
        emitted = [tuple(key[0] if n < 0 else w[3 + n] for n in given_order) for w in settled]
        if not recent:
            return emitted, None, None
        return emitted, (recent,), ceil((recent[0][start] + 0.701 + BEFORE) * 1000) + 1

    carried = f"recent array<struct<at:bigint,norm:string,rank:int,{payload}>>"
    return in_event_order(rows, ["track_id"], ["start", "rank", "end", "word_no"], delay, carried, out, fold)


def live_sync(words: DataFrame, lines: DataFrame, bucket_seconds: float = 10.0, block_seconds: float = 600.0):
    """Batch function: playback positions (track_id, audio_time) to focus line and active words.

    ``words`` and ``lines`` are static timelines; a batch takes only its own tracks from them.
    """

    def sync(batch: DataFrame) -> DataFrame:
        points = batch.select("track_id", display_time(F.col("audio_time")).alias("t")).distinct()
        tracks = points.select("track_id").distinct()
        heard, shown = (df.join(tracks, "track_id", "left_semi") for df in (words, lines))
        focus = focus_line(heard, shown, points, bucket_seconds, block_seconds)
        active = active_at(heard.select("track_id", "start", "end", "idx"), points, bucket_seconds)
        active_words = active.groupBy("track_id", "t").agg(F.count(F.lit(1)).alias("active_words"))
        return focus.join(active_words, ["track_id", "t"], "left").withColumn(
            "active_words", F.coalesce("active_words", F.lit(0))
        )

    return sync
