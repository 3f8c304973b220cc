"""Synthetic signals to regions, and silence inside words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.operators import frames as fr
from cuesheet.plans.percentiles import exact_percentiles

RATE = 1000


def flat(*parts):
    return np.concatenate([np.full(int(s * RATE), v) for s, v in parts])


def regions(spark, signal):
    samples = spark.createDataFrame(
        [(1, i, float(v)) for i, v in enumerate(signal)], "track_id long, idx long, v double"
    )
    sizes = samples.groupBy("track_id").agg(F.count("*").alias("n_samples"))
    found = fr.vocal_regions(fr.frame_rms(samples, RATE), sizes, RATE)
    return [(r.start, r.end) for r in found.orderBy("start").collect()]


def test_silent_intro_is_skipped(spark):
    found = regions(spark, flat((5, 0.0), (10, 0.2)))
    assert len(found) == 1 and found[0][0] > 4 * RATE and found[0][1] == 15 * RATE


def test_quiet_verse_before_loud_chorus(spark):
    found = regions(spark, flat((2, 0.0), (4, 0.015), (8, 0.0), (4, 0.25)))
    assert len(found) == 2
    assert found[0][0] < 2 * RATE and found[0][1] > 5 * RATE
    assert found[1][0] < 14 * RATE and found[1][1] == 18 * RATE


def test_soft_vocals_after_loud_section(spark):
    signal = flat((3, 1.0), (2, 0.0), (2, 0.002))
    assert regions(spark, signal) == [(0, len(signal))]


def test_long_regions_are_split_without_gaps(spark):
    signal = flat((70, 0.12))
    found = regions(spark, signal)
    assert len(found) > 1 and found[0][0] == 0 and found[-1][1] == len(signal)
    assert all(e - s <= 28.5 * RATE for s, e in found)
    assert all(a[1] == b[0] for a, b in zip(found, found[1:]))


def plain_cuts(start, end, levels, hop):
    """Pieces of one region, cut after cut at the first quietest frame of the next window."""
    pieces = []
    while end - start > 28.5 * RATE:
        low = (start + 16 * RATE) // hop
        window = levels[low:(start + 28500) // hop]
        cut = min(end - 200, max(start + 16 * RATE, (low + int(np.argmin(window))) * hop))
        pieces.append((start, cut))
        start = cut
    return pieces + ([(start, end)] if end - start >= 200 else [])


@pytest.mark.parametrize("steps, chunk", [(3, 600), (1000, 4_000), (1, 6_000)])
def test_long_sound_is_cut_in_chunks(spark, steps, chunk):
    """Few distinct levels give ties; a single one never brings two series of cuts together."""
    rng, hop = np.random.default_rng(steps), fr.hop_of(RATE)
    spans = {1: (130, 900_077), 2: (0, 28_500), 3: (64_020, 64_020 + 28_501), None: (0, 100_000)}
    levels = {k: rng.integers(1, steps + 1, size=end // hop + 1) / steps for k, (_, end) in spans.items()}
    schema = "track_id long, start long, end long"
    table = spark.createDataFrame([(k, *span) for k, span in spans.items() if k], schema)
    frames = spark.createDataFrame(
        [(k, i, float(v)) for k, values in levels.items() for i, v in enumerate(values)],
        "track_id long, frame_no long, rms double")
    expected = sorted((k, *piece) for k, (start, end) in spans.items() if k
                      for piece in plain_cuts(start, end, levels[k], hop))
    assert sorted(map(tuple, fr.split_regions(table, frames, RATE, chunk).collect())) == expected


def test_noise_gives_no_region(spark):
    assert regions(spark, flat((12, 0.0002))) == []


def test_isolated_response(spark):
    found = regions(spark, flat((7, 0.0), (1, 0.08), (4, 0.0)))
    assert len(found) == 1 and found[0][0] < 7 * RATE and found[0][1] > 8 * RATE


def test_merge_does_not_depend_on_chunks(spark):
    runs = spark.createDataFrame(
        [(1, 1500 * i, 1500 * i + 700) for i in range(200)], "track_id long, start long, end long"
    )
    whole = sorted(map(tuple, fr.merge_regions(runs, RATE).collect()))
    assert whole == sorted(map(tuple, fr.merge_regions(runs, RATE, chunk=64).collect()))
    assert all(e - s <= 28500 for _, s, e in whole)


def test_silence_is_told_from_a_held_note(spark):
    held = np.full(16000, 0.08)
    split = held.copy()
    split[4800:11200] = 0
    rows = [(k, i, float(v)) for k, s in enumerate((held, split)) for i, v in enumerate(s)]
    samples = spark.createDataFrame(rows, "track_id long, idx long, v double")
    gaps = spark.createDataFrame(
        [(k, 0, 0.2, 0.8, 0.1, 0.9) for k in (0, 1)],
        "track_id long, gap_no long, gap_start double, gap_end double, word_start double, word_end double",
    )
    sizes = samples.groupBy("track_id").agg(F.count("*").alias("n_samples"))
    verdict = {r.track_id: r.silent for r in fr.silent_gaps(gaps, samples, sizes).collect()}
    assert verdict == {0: False, 1: True}


@pytest.mark.parametrize("share", [0.0, 0.18, 0.5, 0.9, 1.0])
def test_exact_percentiles(spark, share):
    rng = np.random.default_rng(1)
    values = {1: rng.normal(size=301), 2: np.repeat([0.0, 0.5], 50), 3: np.array([2.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "k int, v double")
    found = {r.k: r.p for r in exact_percentiles(df, ["k"], "v", {"p": share}).collect()}
    for k, vs in values.items():
        assert found[k] == pytest.approx(np.percentile(vs, share * 100))
