"""Chunked folds: results do not depend on the chunk size, and long islands spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import cleaning as cl
from cuesheet.plans.folds import entry_states

WORDS = "track_id long, word_no long, text string, start double, end double, kind string, phrase int"


def chain(seed, count, step=(0.0, 0.01, 0.05, 0.1, 0.3), track=1):
    """Words of one unbroken chain of repeats."""
    dice = random.Random(seed)
    rows, t = [], 0.0
    for i in range(count):
        t = round(t + dice.choice(step), 3)
        rows.append((track, i, dice.choice("ab"), t, round(t + dice.choice([0.02, 0.05, 0.4]), 3), dice.choice(["lead", "adlib", None]), dice.choice([-1, 1, 2, None])))
    return rows


@pytest.mark.parametrize("step", [(0.0, 0.01, 0.05, 0.1, 0.3), (0.0, 0.005)])
def test_duplicates_do_not_depend_on_chunks(spark, step):
    """The second case never forgets within a chunk: its starts stay within the look-back over many chunks."""
    words = spark.createDataFrame(chain(1, 120, step) + chain(2, 20, step, 2), WORDS)
    whole = sorted(map(tuple, cl.deduplicate_words(words, chunk=10_000).collect()))
    assert 0 < len(whole) < 140
    for chunk in (16,) if len(step) > 2 else (50,):
        assert sorted(map(tuple, cl.deduplicate_words(words, chunk=chunk).collect())) == whole


def test_an_end_is_extended_from_a_later_chunk(spark):
    words = spark.createDataFrame([
        (1, 0, "a", 0.0, 0.5, "lead", 1), (1, 1, "b", 0.1, 0.2, "lead", 1), (1, 2, "b", 0.4, 0.5, "lead", 1), (1, 3, "a", 0.45, 0.9, "lead", 2),
        (1, 4, "a", 0.6, 1.4, "lead", 3)], WORDS)
    for chunk in (2, 9):
        kept = {r.word_no: r.end for r in cl.deduplicate_words(words, chunk=chunk).collect()}
        assert kept == {0: 1.4, 1: 0.2, 2: 0.5}


def test_a_hundredfold_island_spreads_over_tasks(spark):
    """One track, one island of 40,000 words: chunks are the units of work, and no array holds more than one."""
    words = spark.range(40_000).select(
        F.lit(1).cast("long").alias("track_id"), F.col("id").alias("word_no"), F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("text"),
        (F.col("id") * 0.05).alias("start"), (F.col("id") * 0.05 + 0.06).alias("end"), F.lit("lead").alias("kind"), (F.col("id") % 5).cast("int").alias("phrase"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = cl.deduplicate_words(words)
        assert 0 < kept.count() < 40_000
        scanned = kept.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(scanned) > 2 and max(r["count"] for r in scanned) < 30_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_entry_states_settle_and_are_exact(spark):
    """A running sum modulo 97 never forgets: every chunk's entry is still the sum of all before it."""
    rows = [(k, n, n * 7 % 31) for k in "xy" for n in range(30)]
    chunks = spark.createDataFrame(rows, "key string, pos long, v long").groupBy("key", F.floor(F.col("pos") / 9).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("rows"))
    leave = lambda rows, entry: F.aggregate(rows, entry, lambda a, r: (a + r["v"]) % 97)
    found = entry_states(chunks, ["key"], F.lit(0).cast("long"), leave, lambda state, first: state)
    values = [n * 7 % 31 for n in range(30)]
    assert {(r.key, r.chunk): r.entry for r in found.collect()} == {(k, c): sum(values[:9 * c]) % 97 for k in "xy" for c in range(4)}
