"""The whole cleaning chain on small tracks: golden cases and properties."""

import random

from cuesheet.operators.transcript import finish_words

SCHEMA = ("track_id long, word_no long, text string, start double, end double, kind string, phrase int, "
          "source_layer string, timing array<struct<start:double,end:double,fill:double,pause_before:boolean>>")


def finished(spark, rows):
    df = spark.createDataFrame([(1, n, *row, []) for n, row in enumerate(rows)], SCHEMA)
    return sorted(finish_words(df).collect(), key=lambda r: r.word_no)


def test_side_phrase_that_repeats_the_lead_is_dropped(spark):
    rows = [("love", 1.0, 1.4, "lead", 1, "center"), ("love", 1.1, 1.4, "adlib", 2, "side"), ("hey", 1.5, 1.9, "adlib", 3, "side")]
    assert [r.text for r in finished(spark, rows)] == ["love", "hey"]


def test_nulls_take_the_defaults(spark):
    rows = [("one", 1.0, 1.4, None, None, None), ("two", 2.0, 2.4, "adlib", None, None), ("two", 2.05, 2.5, "adlib", 4, None)]
    found = finished(spark, rows)
    assert [(r.text, r.kind) for r in found] == [("one", "lead"), ("two", "adlib")]
    assert found[1].end >= 2.5


def test_chain_properties(spark):
    """Tracks do not influence one another, and what stays is a subset in order."""
    random.seed(21)
    rows, t = [], 0.0
    for i in range(250):
        t = round(t + random.choice([0.0, 0.08, 0.2, 0.9]), 3)
        phrase = i // random.choice([2, 4]) if i % 11 else None
        rows.append((random.choice(["oh", "Yeah,", "la", "\u2014", "don't"]), t, round(t + random.choice([0.05, 0.2, 0.5]), 3),
                     random.choice(["lead", "adlib"]), phrase, random.choice(["side", "center", None])))
    df = spark.createDataFrame([(track, n, *row, []) for track in (1, 2) for n, row in enumerate(rows)], SCHEMA)
    found = finish_words(df).collect()
    first, second = (sorted((r.word_no, r.text, r.start, r.end, r.kind) for r in found if r.track_id == track) for track in (1, 2))
    assert first == second and 0 < len(first) < len(rows)
    assert all(text == rows[n][0] and text != "\u2014" for n, text, start, end, _ in first)
    assert {r[0] for r in first} >= {n for n, r in enumerate(rows) if r[3] == "lead" and r[0] != "\u2014" and not any(
        q[0] == r[0] and abs(q[1] - r[1]) < 1.5 for m, q in enumerate(rows) if m != n)}


def test_stored_normal_forms_give_the_same_words(spark):
    from cuesheet.operators.cleaning import deduplicate_words, with_norm

    rows = [(1, i, w, i * 0.1, i * 0.1 + 0.3, "lead", i, None, []) for i, w in enumerate(["Oh", "oh!", "(oh)", "-", "yeah", None, "OH"])]
    words = spark.createDataFrame(rows, SCHEMA)
    normed = deduplicate_words(with_norm(words))
    assert normed.columns == words.columns
    assert sorted(map(str, normed.collect())) == sorted(map(str, deduplicate_words(words).collect()))
