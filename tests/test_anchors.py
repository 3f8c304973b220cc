"""Cuts of long pairs lie on every cheapest path, and pieces together give the path of the whole."""

import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cuesheet.functions.edit import edit_distance, edit_path
from cuesheet.operators import evaluation as ev
from cuesheet.operators.anchors import GRAM, certain_cuts, cut_long_pairs

TOKENS = "track_id long, label string, pos long, text string, normalized string, start double, end double, kind string"


def damaged(dice, reference, rate, vocab):
    out = []
    for token in reference:
        x = dice.random()
        if x < rate:
            continue
        out.append(dice.choice(vocab) if x < 2 * rate else token)
        if x > 1 - rate:
            out.append(dice.choice(vocab))
    return out


def runs_of(reference, candidate):
    grams = lambda s: [tuple(s[k:k + GRAM]) for k in range(len(s) - GRAM + 1)]
    a, b = grams(reference), grams(candidate)
    where = {g: j for j, g in enumerate(b) if b.count(g) == 1}
    anchors = [(i, where[g]) for i, g in enumerate(a) if g in where and a.count(g) == 1]
    runs = []
    for i, j in anchors:
        if runs and (i, j) == (runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]):
            runs[-1][2] += 1
        else:
            runs.append([i, j, 1])
    return [(i, j, n + GRAM - 1) for i, j, n in runs]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([3, 8, 50]), st.sampled_from([0.0, 0.03, 0.1]))
def test_cuts_are_on_the_path(seed, words, rate):
    dice = random.Random(seed)
    vocab = [f"w{n}" for n in range(words)]
    reference = [dice.choice(vocab) for _ in range(160)]
    candidate = damaged(dice, reference, rate, vocab)
    if dice.random() < 0.3:  # a passage that moves
        candidate = candidate[60:90] + candidate[:60] + candidate[90:]
    cuts = certain_cuts(runs_of(reference, candidate), len(reference), len(candidate))
    whole = list(edit_path(reference, candidate)[0])
    assert edit_distance(reference, candidate) == sum(op > 0 for op in whole)
    parts, at = [], (0, 0)
    for i, j in [*cuts, (len(reference), len(candidate))]:
        parts += list(edit_path(reference[at[0]:i], candidate[at[1]:j])[0])
        at = (i, j)
    assert parts == whole


def test_clean_stretches_give_cuts():
    dice = random.Random(4)
    vocab = [f"w{n}" for n in range(300)]
    reference = [dice.choice(vocab) for _ in range(2000)]
    assert len(certain_cuts(runs_of(reference, damaged(dice, reference, 0.01, vocab)), 2000, 2000)) > 10
    assert certain_cuts([], 10, 10) == []


def rows(spark, track, label, sequence):
    data = [(track, label, 3 * n, t, t, n * 1.0 if n % 3 else None, n + 0.5 if n % 3 else None, "lead") for n, t in enumerate(sequence)]
    return spark.createDataFrame(data, TOKENS)


def test_pieces_of_one_pair_run_in_several_tasks(spark):
    dice = random.Random(6)
    vocab = [f"w{n}" for n in range(400)]
    reference = [dice.choice(vocab) for _ in range(1500)]
    other = [dice.choice(vocab) for _ in range(40)]
    candidates = {(1, "a"): damaged(dice, reference, 0.03, vocab), (1, "b"): [dice.choice(vocab) for _ in range(900)], (2, "a"): damaged(dice, other, 0.1, vocab)}
    ref = rows(spark, 1, "x", reference).unionByName(rows(spark, 2, "x", other)).drop("label")
    cand = None
    for (track, label), sequence in candidates.items():
        part = rows(spark, track, label, sequence)
        cand = part if cand is None else cand.unionByName(part)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        steps = ev.align(ref, cand, piece=100).cache()
        found = {}
        for r in steps.orderBy("track_id", "label", "step_no").collect():
            found.setdefault((r.track_id, r.label), []).append(ev.OPERATIONS.index(r.operation))
        for (track, label), sequence in candidates.items():
            assert found[track, label] == list(edit_path(reference if track == 1 else other, sequence)[0])
        cut = cut_long_pairs(ref, cand, ev.pair_sizes(ref, cand), 100).repartition("track_id", "label", "number")
        pieces = cut.filter("track_id = 1 and label = 'a'").select(F.size("ref").alias("n"), F.spark_partition_id().alias("task")).collect()
        assert len({r.task for r in pieces}) > 1 and sum(r.n for r in pieces) == len(reference) and max(r.n for r in pieces) < 800
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    cut, whole = (sorted(map(tuple, ev.evaluate(ref, cand, piece=p).collect())) for p in (100, 10_000))
    assert cut == whole and len(whole) == 3


def test_long_sequences_need_little_memory_and_time():
    dice = random.Random(8)
    vocab = list(range(2000))
    reference = [dice.choice(vocab) for _ in range(20_000)]
    candidate = damaged(dice, reference, 0.05, vocab)
    ops, down, along = edit_path(reference, candidate)
    assert down.max() == 19_999 and along.max() == len(candidate) - 1
    assert (ops != 0).sum() == edit_distance(reference, candidate)
