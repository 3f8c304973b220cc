from pyspark.sql import functions as F

from cuesheet.operators import lines as ln

WORD = "track_id long, word_no long, text string, start double, end double, kind string, phrase int"


def _sung(spark, tracks, n):
    """Words without pauses, whose lines end by length only."""
    rows = [(t, i, f"w{i}", i * 0.3, i * 0.3 + 0.28, "lead", 0) for t in tracks for i in range(n)]
    return spark.createDataFrame(rows, WORD)


def test_long_islands_without_a_track_fold_like_any_other(spark):
    found = ln.group_lines(_sung(spark, [None, 5], 100), chunk=17).select(
        "track_id", "start", F.size("words").alias("n")).collect()
    of = lambda track: sorted((r.start, r.n) for r in found if r.track_id == track)
    assert of(None) == of(5) and sum(n for _, n in of(5)) == 100


def test_offsets_come_with_the_numbers(spark):
    lines = ln.group_lines(_sung(spark, [None, 1, 2], 60))
    together = ln.number_lines(lines, block_seconds=5.0, offsets=True)
    apart = ln.line_word_offsets(ln.number_lines(lines, block_seconds=5.0))
    shown = lambda df: sorted(map(str, df.select("track_id", "line_no", "word_offset", "words").collect()))
    assert shown(together) == shown(apart)
    places = lambda df: sorted(map(str, ln.word_timeline(df).collect()))
    assert places(together) == places(apart)
