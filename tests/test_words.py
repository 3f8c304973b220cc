"""Small cases with known results: words, lines, cleaning, text forms."""

import pytest
from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.functions.fill import word_fill_at
from cuesheet.functions.numeric import round_exact, to_ppm
from cuesheet.functions.spoken import spoken_form
from cuesheet.operators import cleaning as cl, intervals as iv, lines as ln, phrases as ph

WORDS = "track_id long, word_no long, text string, start double, end double, kind string, phrase int"


def words(spark, rows):
    return spark.createDataFrame(
        [(1, i, t, s, e, k, p) for i, (t, s, e, k, p) in enumerate(rows)], WORDS
    )


def collected(df, *order):
    return df.orderBy(*order).collect()


def test_rounding_matches_python(spark):
    values = [2.6755, 0.0625, 0.0615, 1.0005, 2.5, 0.1235, 83.125, 1e-9, 12345.6785, 0.0005, 1.2345]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", round_exact(F.col("x")).alias("r")).collect():
        assert row.r == round(row.x, 3)


def test_duplicates_of_overlapping_windows_are_dropped(spark):
    df = words(spark, [("hello", 1.0, 1.3, "lead", -1), ("hello", 1.2, 1.5, "lead", -1),
                       ("world", 1.6, 2.0, "lead", -1)])
    kept = collected(cl.deduplicate_words(df), "start")
    assert [r.text for r in kept] == ["hello", "world"] and kept[0].end == 1.5


def test_repeat_inside_one_phrase_stays(spark):
    df = words(spark, [("yeah", 1.0, 1.2, "lead", 3), ("yeah", 1.3, 1.5, "lead", 3)])
    assert cl.deduplicate_words(df).count() == 2


def test_long_gap_breaks_a_line(spark):
    df = words(spark, [("first", 1.0, 1.3, "lead", -1), ("line", 1.4, 1.8, "lead", -1),
                       ("second", 3.0, 3.4, "lead", -1)])
    lines = collected(ln.words_to_lines(df), "line_no")
    assert len(lines) == 2 and lines[1].start == 3.0 and lines[1].line_id == "line-1-lead-3.0"


def test_phrases_and_adlibs_make_their_own_lines(spark):
    df = words(spark, [("lead", 1.0, 1.3, "lead", 1), ("vocal", 1.4, 1.8, "lead", 1),
                       ("new", 2.0, 2.2, "lead", 2), ("phrase", 2.3, 2.7, "lead", 2),
                       ("(yeah)", 2.1, 2.5, "adlib", 7)])
    lines = collected(ln.words_to_lines(df), "line_no")
    assert [l.kind for l in lines] == ["lead", "lead", "adlib"]
    assert [len(l.words) for l in lines] == [2, 2, 1]


def test_more_confident_phrase_wins(spark):
    df = spark.createDataFrame(
        [(1, 0, "correct", 1.0, 1.4, 1, 0.8), (1, 1, "guess", 1.1, 1.5, 2, 0.2),
         (1, 2, "continues", 1.6, 2.0, 2, 0.2)],
        "track_id long, word_no long, text string, start double, end double, segment int, "
        "segment_confidence double",
    )
    kept = collected(cl.resolve_overlaps(df), "start")
    assert [r.text for r in kept] == ["correct", "continues"]


def test_units_survive_publishing(spark):
    units = [(1.05, 1.18, 0.1, None), (1.18, 1.31, 0.2, None), (1.31, 1.44, 0.3, None),
             (1.82, 1.95, 0.4, True), (1.95, 2.14, 1.0, None)]
    df = spark.createDataFrame(
        [(1, 0, "conflicted", 1.0, 2.2, "lead", 1, units)],
        "track_id long, word_no long, text string, start double, end double, kind string, "
        f"segment int, timing {cl.TIMING}",
    )
    timing = cl.publish_words(df).first().timing
    assert len(timing) == 5 and timing[2].fill == 0.3 and timing[3].start == 1.82
    assert timing[3].pause_before and timing[-1].fill == 1.0


def test_spaces_are_those_of_the_class(spark):
    spaces = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    rows = [(t,) for c in spaces for t in (c, f"{c}a{c}b{c}")] + [("",), (None,), (" \u3000\n",), ("\u2003é\U0001f600 \u0085",)]
    df = spark.createDataFrame(rows, "t string")
    plain = F.regexp_replace("t", rf"^{tx.SPACE}|{tx.SPACE}$", "")
    assert df.filter(~tx.strip_space(F.col("t")).eqNullSafe(plain)).count() == 0
    assert df.filter(F.col("t").rlike(f"^{tx.SPACE}$")).select("t").distinct().count() == len(tx.SPACES) + 1


def test_polish_removes_overlap_between_phrases(spark):
    df = words(spark, [("one", 1.0, 1.5, "lead", 1), ("two", 1.4, 1.8, "lead", 2)])
    first, second = collected(cl.polish_timings(df), "start")
    assert first.end <= second.start


@pytest.mark.parametrize("kind", ["lead", "adlib", None])
def test_polish_properties(spark, kind):
    """No row is lost, order is kept, no phrase overlaps itself, and the block size does not matter."""
    import random

    random.seed(5)
    rows, t = [], 0.0
    for i in range(300):
        t = round(t + random.choice([0.0, 0.02, 0.05, 0.2, 1.0]), 3)
        phrase = i // random.choice([1, 5, 9]) if i % 7 else None
        rows.append(("w", t, round(t + random.choice([0.01, 0.05, 0.3]), 3), kind, phrase))
    df = words(spark, rows)
    found = collected(cl.polish_timings(df, 60.0), "word_no")
    assert found == collected(cl.polish_timings(df, 0.5), "word_no")
    assert [r.word_no for r in found] == [r.word_no for r in collected(df, "word_no")]
    assert all(r.phrase is not None and r.kind == (kind or "lead") for r in found)
    phrases = {}
    for r in sorted(found, key=lambda r: r.word_no):
        phrases.setdefault(r.phrase, []).append(r)
    for group in phrases.values():
        given = sorted(group, key=lambda r: (rows[r.word_no][1], rows[r.word_no][2], r.word_no))
        assert all(a.start <= b.start + 0.1 for a, b in zip(given, given[1:]))
        if kind == "adlib":
            assert all(a.end <= b.start for a, b in zip(given, given[1:]))


def test_dedup_properties(spark):
    """Idempotent up to the ends it extends, a subset of the words, and free of block effects; nulls are kept."""
    import random

    random.seed(7)
    rows, t = [], 0.0
    for i in range(400):
        t = round(t + random.choice([0.0, 0.05, 0.1, 0.3, 0.9]), 3)
        rows.append((random.choice("abc"), t, round(t + random.choice([0.05, 0.4]), 3),
                     random.choice(["lead", "adlib", None]), random.choice([-1, 1, 2, 3, None])))
    df = words(spark, rows)
    found = cl.deduplicate_words(df)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, cl.deduplicate_words(df, block_seconds=1.0).collect()))
    kept = {r.word_no: r for r in found.collect()}
    assert 0 < len(kept) < len(rows)
    for number, r in kept.items():
        assert (r.text, r.start) == rows[number][:2] and r.end >= rows[number][2]


def test_missing_phrase_repeats_any_phrase(spark):
    df = words(spark, [("hello", 1.0, 1.3, "lead", None), ("hello", 1.1, 1.5, "lead", 3)])
    (only,) = cl.deduplicate_words(df).collect()
    assert (only.start, only.end, only.phrase) == (1.0, 1.5, -1)



def test_lines_do_not_depend_on_chunk_or_block_size(spark):
    import random

    random.seed(3)
    rows, t = [], 0.0
    for i in range(900):
        t = round(t + random.choice([0.1, 0.2, 0.3]), 3)
        rows.append((random.choice(["la", "end.", "so"]), t, round(t + 0.3, 3),
                     random.choice(["lead", "lead", "adlib"]), i // 40))
    df = words(spark, rows)
    shape = lambda l: sorted((r.kind, r.start, r.end, [w.word_no for w in r.words]) for r in l.collect())
    whole = shape(ln.group_lines(df))
    assert whole == shape(ln.group_lines(df, block_seconds=3.0, chunk=16))
    assert sorted(n for _, _, _, w in whole for n in w) == list(range(900))


def test_side_phrase_that_repeats_the_lead_is_dropped(spark):
    lead = words(spark, [("hold", 1.0, 1.3, "lead", 1), ("on", 1.4, 1.6, "lead", 1)])
    side = spark.createDataFrame(
        [(1, 10, "hold", 1.1, 1.3, 5, "side"), (1, 11, "on", 1.4, 1.5, 5, "side"),
         (1, 12, "oh", 1.2, 1.4, 6, "side"), (1, 13, "hold", 1.1, 1.2, 7, "center")],
        "track_id long, word_no long, text string, start double, end double, phrase int, source_layer string",
    )
    kept = cl.adlib_filter(side, lead)
    assert sorted(r.phrase for r in kept.collect()) == [6, 7]


def test_parenthetical_words(spark):
    df = spark.createDataFrame(
        [(1, i, p) for i, p in enumerate(["main", "(backing", "vocal)", "main"])], "phrase int, pos int, piece string"
    )
    flags = collected(ph.parenthetical_flags(df, ["phrase"], "pos", "piece"), "pos")
    assert [r.parenthetical for r in flags] == [False, True, True, False]


def test_proportional_timing(spark):
    df = spark.createDataFrame(
        [(1, i, p) for i, p in enumerate(["a", "much", "longer"])], "phrase int, pos int, piece string"
    )
    timed = collected(
        ph.proportional_timings(df, ["phrase"], "pos", "piece", F.lit(1.0), F.lit(3.0)), "pos"
    )
    assert timed[0].start == 1.0 and timed[-1].end == 4.0
    assert timed[2].end - timed[2].start > timed[0].end - timed[0].start


@pytest.mark.parametrize(
    "text, expected",
    [("21", "TWENTYONE"), ("24/7", "TWENTYFOURSEVEN"), ("$100", "ONEHUNDREDDOLLARS"),
     ("3.14", "THREEPOINTONEFOUR"), ("21st", "TWENTYFIRST"), ("1000000000000", "ONETHOUSANDBILLION"),
     ("2000th", "TWOTHOUSANDTH"), ("5%21st", "FIVEPERCENTTWENTYONEST"), ("naïve", "NAVE")],
)
def test_spoken_form(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(spoken_form(F.col("t"))).first()[0] == expected


def test_spoken_marks_are_not_numbers(spark):
    """Letters that the passes use as marks count as letters of the text, also around digits."""
    texts = [("ꙮNabꙮ 7",), ("ꙮC7ꟷ",), ("$5O$6",), ("5%C6%",), ("1.2.3%",), ("1.2nd",), ("$٣,٠٠٠.50th",), (None,)]
    spoken = [r[0] for r in spark.createDataFrame(texts, "t string").coalesce(1).select(spoken_form(F.col("t"))).collect()]
    assert spoken == [
        "NABSEVEN", "CSEVEN", "FIVEDOLLARSOSIXDOLLARS", "FIVEPERCENTCSIXPERCENT", "ONETWOPOINTTHREEPERCENT", "ONESECOND",
        "THREETHOUSANDPOINTFIVEZERODOLLARSTH", None]


def test_text_forms(spark):
    df = spark.createDataFrame([("  HéLLo—WORLD!  ",), ("Don’t",), ("STRASSE ß",), ("ﬁne_",)], "t string")
    forms = [r[0] for r in df.select(tx.normalize_for_evaluation(F.col("t"))).collect()]
    assert forms == ["hélloworld", "don't", "strassess", "fine"]


@pytest.mark.parametrize(
    "name, title, artist, safe",
    [("My_Song - The Band.mp3", "My Song", "The Band", "My-Song"), ("x.mp3", "x", "Local audio", "x"),
     ("a - b - c.wav", "a", "b — c", "a"), ("!!.mp3", "!!", "Local audio", "lyrics")],
)
def test_titles(spark, name, title, artist, safe):
    df = spark.createDataFrame([(name,)], "f string").select(tx.track_title(F.col("f")).alias("t"))
    row = df.select("t.title", "t.artist", tx.safe_title(F.col("t.title")).alias("safe")).first()
    assert (row.title, row.artist, row.safe) == (title, artist, safe)


@pytest.mark.parametrize("t, stamp", [(0.0, "[00:00.00]"), (59.999, "[00:60.00]"), (83.125, "[01:23.13]"),
                                      (6000.5, "[100:00.50]"), (2.675, "[00:02.67]")])
def test_lrc_stamp(spark, t, stamp):
    assert spark.range(1).select(tx.lrc_stamp(F.lit(t))).first()[0] == stamp


def test_fill(spark):
    units = [(1.0, 1.1, 0.25, False), (1.1, 1.18, 0.5, False), (1.5, 1.7, 1.0, True)]
    schema = f"start double, end double, t double, timing {cl.TIMING}"
    df = spark.createDataFrame(
        [(1.0, 2.0, 1.14, units), (1.0, 2.0, 1.3, units), (2.0, 4.0, 3.0, None), (2.0, 4.0, 4.0, None)], schema
    )
    fill = word_fill_at(F.col("start"), F.col("end"), F.col("timing"), F.col("t"))
    values = [r[0] for r in df.select(fill).collect()]
    assert values == pytest.approx([0.375, 0.5, 0.5, 1.0])


def test_halves_of_a_millionth_go_away_from_zero(spark):
    shares = spark.createDataFrame([(0.9828125,), (0.0000005,), (0.25,)], "x double")
    assert [r[0] for r in shares.select(to_ppm(F.col("x"))).collect()] == [982813, 1, 250000]


def test_interval_lookups(spark):
    rows = [(0, 0.0, 0.5), (1, 1.0, 4.0), (2, 1.5, 2.2), (3, 1.8, 2.6), (4, 9.0, 10.0)]
    table = spark.createDataFrame([(1, *r) for r in rows], "track_id int, i int, start double, end double")
    times = spark.createDataFrame([(1, t) for t in (2.0, 4.0, 9.5, -1.0)], "track_id int, t double")
    active = {}
    for r in iv.active_at(table, times, 0.7).collect():
        active.setdefault(r.t, []).append(r.i)
    assert {k: sorted(v) for k, v in active.items()} == {2.0: [1, 2, 3], 9.5: [4]}
    started = spark.createDataFrame(
        [(1, i, s, e) for i, (s, e) in enumerate([(1.0, 2.0), (3.0, 4.0), (3.0, 5.0), (8.0, 9.0)])],
        "track_id int, i int, start double, end double",
    )
    asked = spark.createDataFrame([(1, t) for t in (0.9, 1.0, 3.0, 100.0)], "track_id int, t double")
    found = {r.t: r.idx for r in iv.last_started(started, asked, "i", block_seconds=2.0).collect()}
    assert found == {0.9: -1, 1.0: 0, 3.0: 2, 100.0: 3}


def test_union_is_disjoint(spark):
    import random

    random.seed(11)
    rows = [(1, i, float(random.randint(0, 400)), 0.0) for i in range(200)]
    rows = [(k, i, s, s + random.choice([1, 2, 30])) for k, i, s, _ in rows]
    table = spark.createDataFrame(rows, "track_id int, i int, start double, end double")
    for width in (3.0, 1000.0):
        merged = collected(iv.merge_intervals(table, "i", width), "start")
        assert sum(r.members for r in merged) == 200
        assert all(a.end < b.start for a, b in zip(merged, merged[1:]))
        covered = {x for _, _, s, e in rows for x in range(int(s), int(e))}
        assert sum(r.end - r.start for r in merged) == len(covered)


def test_python_folds_distinct_values_only(spark):
    """Casefolding beyond ASCII: the Python node stands above a distinct, and results equal the plain column."""
    rows = [(n, ["Straße", "ÉTÉ", "plain", "ﬁn", None, "UPPER"][n % 6]) for n in range(60)]
    df = spark.createDataFrame(rows, "n long, t string")
    found = tx.with_folded(df, F.col("t"), "folded")
    expected = {r.n: r.f for r in df.select("n", tx.fold_unicode(F.col("t")).alias("f")).collect()}
    assert {r.n: r.folded for r in found.collect()} == expected and found.columns == ["n", "t", "folded"]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    (at,) = [k for k, line in enumerate(plan) if "ArrowEvalPython" in line]
    assert "Aggregate" in plan[at + 1]


def test_numbers_in_digits_of_any_script(spark):
    from cuesheet.functions.spoken import spoken_form

    df = spark.createDataFrame([("٢١st at ５%",), ("$ १२.५",), ("21st at 5%",)], "t string")
    forms = [r[0] for r in df.select(spoken_form(F.col("t"))).collect()]
    assert forms == ["TWENTYFIRSTATFIVEPERCENT", "TWELVEPOINTFIVEDOLLARS", "TWENTYFIRSTATFIVEPERCENT"]
