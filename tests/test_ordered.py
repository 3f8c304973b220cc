"""Streams in event-time order: late rows, one result per key, and state that stays small."""

import glob
import random

from pyspark.sql import functions as F

from cuesheet.catalog.streaming import _arriving
from cuesheet.operators.cleaning import deduplicate_words
from cuesheet.plans.session import shared_folder
from cuesheet.streaming import jobs as sj, words as sw
from cuesheet.streaming.sinks import drain

EVENTS = "job_id string, ts timestamp, stage string, no int"


def arriving(spark, path, schema, batches):
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def at(hour):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour)


END = ("~", at(10**6), "complete", 0)


def test_the_first_end_by_event_time_wins(spark, tmp_path):
    batches = [
        [("a", at(5), "error", 1), ("b", at(4), "transcribing", 1), ("c", at(5), "complete", 2), ("c", at(5), "error", 1)],
        [("a", at(3), "complete", 2), ("b", at(6), "complete", 3)],  # later than it happened
        [("a", at(40), "cancelled", 4), ("b", at(41), "error", 5)],
        [END],
    ]
    found = drain(sj.terminal_once(arriving(spark, str(tmp_path / "e"), EVENTS, batches), "4 hours", ["no"]), "append", "t-first")
    rows = {(r.job_id, r.ts, r.stage) for r in found.filter("job_id <> '~'").collect()}
    assert rows == {("a", at(3), "complete"), ("b", at(6), "complete"), ("c", at(5), "error")}
    assert found.filter("job_id <> '~'").count() == 3


def test_a_job_expires_once(spark, tmp_path):
    batches = [
        [("kept", at(1), "transcribing", 0), ("gone", at(1), "complete", 0), ("late", at(1), "complete", 0), ("back", at(1), "complete", 0)],
        [("late", at(20), "error", 0), ("back", at(60), "complete", 0), ("gone", at(30), "transcribing", 0)],
        [("back", at(200), "complete", 0)],
        [END],
    ]
    found = drain(sj.retention_expiries(arriving(spark, str(tmp_path / "e"), EVENTS, batches), 24, "2 hours", ["no"]), "append", "t-once")
    rows = sorted((r.job_id, r.last_event, r.stage) for r in found.filter("job_id <> '~'").collect())
    assert rows == [("back", at(1), "complete"), ("gone", at(1), "complete"), ("late", at(20), "error")]


WORDS = "track_id long, word_no long, text string, start double, end double, kind string, phrase int"


def test_streamed_words_equal_the_batch(spark, tmp_path):
    """Words arrive out of order, in several batches, from time 0 on."""
    dice = random.Random(9)
    rows, t = [], 0.0
    for i in range(150):
        rows.append((1, i, dice.choice("ab"), round(t, 3), round(t + dice.choice([0.05, 0.4]), 3), dice.choice(["lead", "adlib", None]), dice.choice([-1, 1, 2, None])))
        t += dice.choice([0.0, 0.05, 0.2, 0.9])
    order = sorted(rows, key=lambda r: r[3] + dice.random() * 2)
    batches = [order[:70], order[70:], [(-1, 0, "end", 4e6, 4e6 + 1, "lead", 0)]]
    stream = arriving(spark, str(tmp_path / "w"), WORDS, batches)
    kept = drain(sw.stream_dedup(stream, "3 seconds"), "append", "t-words").filter("track_id = 1").drop("_batch")
    expected = deduplicate_words(spark.createDataFrame(rows, WORDS))
    assert sorted(map(tuple, kept.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))


def test_state_of_unbroken_sound_is_small(spark, monkeypatch):
    """Ten thousand words without a gap: no more than a line, or the recent words, is carried."""
    folds = {}
    monkeypatch.setattr(sw, "in_event_order", lambda rows, keys, order, delay, carried, out, fold: folds.setdefault(len(folds), (rows.columns, keys, fold)))
    words = spark.createDataFrame([], WORDS)
    sw.stream_lines(words)
    sw.stream_dedup(words)
    (_, _, lines), (columns, _, dedup) = folds[0], folds[1]
    assert columns[:4] == ["track_id", "ts", "norm", "rank"]
    state, closed = None, 0
    for n in range(10_000):
        row = (n * 100_000 + 1_000_000, n, "la", n * 0.1, n * 0.1 + 0.1, 0, False)
        found, state, _ = lines((1, "lead"), state, [row], n * 100)
        closed += len(found)
        assert state is None or len(state[0]) <= 12
    assert closed >= 10_000 // 12
    state, settled = None, 0
    for n in range(10_000):
        row = (n * 10_000 + 1_000_000, "la", 0, n, "la", n * 0.01, n * 0.01 + 0.005, "lead", n)
        found, state, _ = dedup((1,), state, [row], n * 10)
        settled += len(found)
        assert state is None or len(state[0]) <= 12
    assert settled


def test_memory_and_the_exact_end_of_the_retention(spark, tmp_path):
    """Ends within the memory are dropped, one after it counts again; an event at the very end of the retention is in time."""
    batches = [
        [("a", at(1), "complete", 0), ("a", at(30), "error", 0), (None, at(2), "complete", 1), (None, at(2), "error", 0)],
        [("a", at(200), "complete", 0), (None, at(9), "complete", 0)],
        [END],
    ]
    found = drain(sj.terminal_once(arriving(spark, str(tmp_path / "m"), EVENTS, batches), "4 hours", ["no"], 48), "append", "t-memory")
    rows = sorted(((r.job_id, r.ts, r.stage) for r in found.collect() if r.job_id != "~"), key=str)
    assert rows == sorted([("a", at(1), "complete"), ("a", at(200), "complete"), (None, at(2), "error")], key=str)
    batches = [
        [("exact", at(1), "complete", 0), ("over", at(1), "complete", 0)],
        [("exact", at(25), "transcribing", 0), ("over", at(26), "transcribing", 0)],
        [END],
    ]
    found = drain(sj.retention_expiries(arriving(spark, str(tmp_path / "x"), EVENTS, batches), 24, "30 hours", ["no"]), "append", "t-exact")
    assert [(r.job_id, r.last_event) for r in found.filter("job_id <> '~'").collect()] == [("over", at(1))]


def test_jobs_share_their_states(spark, tmp_path):
    """A state for each job took a worker most of the time; the number of groups bounds the states of a batch."""
    jobs = [(f"j{n}", at(n % 7), "complete", 0) for n in range(300)]
    stream = arriving(spark, str(tmp_path / "p"), EVENTS, [jobs, [(j, at(50), s, n) for j, _, s, n in jobs], [END]])
    for built in (sj.terminal_once(stream, "4 hours", ["no"], groups=3), sj.retention_expiries(stream, 24, "2 hours", ["no"], groups=3)):
        assert "groupingAttributes" not in built.columns
        plan = built._jdf.queryExecution().analyzed().toString()
        assert "TransformWithStateInPySpark" in plan and "_group" in plan
        rows = drain(built, "append", "t-groups").filter("job_id <> '~'").collect()
        assert sorted(r.job_id for r in rows) == sorted(j[0] for j in jobs)


def test_tracks_share_their_states(spark, tmp_path):
    """A state for each track cost several round trips a track; rows of a group's tracks stay apart."""
    dice = random.Random(4)
    rows = []
    for track in range(40):
        t = dice.random()
        for i in range(12):
            rows.append((track, i, dice.choice("ab"), round(t, 3), round(t + 0.3, 3), "lead", dice.choice([-1, 1])))
            t += dice.choice([0.05, 0.2, 0.9])
    order = sorted(rows, key=lambda r: r[3] + dice.random() * 2)
    end = (-1, 0, "end", 4e6, 4e6 + 1, "lead", 0)
    stream = arriving(spark, str(tmp_path / "s"), WORDS, [order[:200], order[200:], [end]])
    built = sw.stream_dedup(stream, "3 seconds")
    plan = built._jdf.queryExecution().analyzed().toString()
    assert "TransformWithStateInPySpark" in plan and "_group" in plan
    kept = drain(built, "append", "t-shared").filter("track_id >= 0")
    expected = deduplicate_words(spark.createDataFrame(rows, WORDS))
    found = [sorted(map(tuple, df.select(*expected.columns).collect()), key=str) for df in (kept, expected)]
    assert found[0] == found[1]


def test_sessions_equal_the_plain_rule(spark, tmp_path):
    """Events out of order, ties, null jobs, stages and ties, several ends of a job; no store of sessions of Spark's own."""
    dice = random.Random(5)
    rows = [(dice.choice(["a", "b", "c", None]), at(dice.randrange(1500)), dice.choice(["complete", "error", "transcribing", None]), dice.choice([None, 1, 2, 3]))
            for _ in range(120)]
    # of events at one time the tie decides, so it is a different one for each
    rows = [*{(job, ts, no): (job, ts, stage, no) for job, ts, stage, no in rows}.values()]
    order = sorted(rows, key=lambda r: r[1] + (at(dice.random() * 20) - at(0)))
    batches = [order[:40], order[40:50], order[50:], [END]]
    built = sj.retention_expiries(arriving(spark, str(tmp_path / "s"), EVENTS, batches), 24, "24 hours", ["no"], 200, groups=2)
    assert "session_window" not in built._jdf.queryExecution().analyzed().toString().lower()
    found = drain(built, "append", "t-sessions").filter("job_id is null or job_id <> '~'").collect()
    expected, day = [], at(24) - at(0)
    for job in ("a", "b", "c", None):
        mine, until = sorted(((r[1], r[3] or 0, r[2]) for r in rows if r[0] == job), key=lambda r: r[:2]), at(0)
        for (ts, _, stage), after in zip(mine, [*mine[1:], None]):
            if (after is None or after[0] > ts + day) and stage in ("complete", "error") and ts + day >= until:
                expected.append((job, stage, ts))
                until = ts + day + (at(200) - at(0))
    assert len(expected) > 8
    assert sorted(((r.job_id, r.stage, r.last_event) for r in found), key=str) == sorted(expected, key=str)


def test_batches_that_arrive_have_many_files(spark):
    """A batch was one file, which a single task wrote and read; the rows of a batch still come together."""
    days = F.when(F.col("id") < 40, F.col("id")).when(F.col("id") < 45, 1500 + F.col("id")).otherwise(2700 + F.col("id"))
    events = spark.range(75).select(
        F.col("id").alias("job_id"), F.date_add(F.lit("1992-01-01"), days.cast("int")).cast("timestamp").alias("ts"),
        F.lit("complete").alias("stage"), F.col("id").cast("int").alias("no")).repartition(6)
    stream = _arriving(spark, events, "t-many", rows_per_file=5)
    found = drain(stream, "append", "t-many-read").filter("job_id >= 0").collect()
    batches = {}
    for r in found:
        batches.setdefault(r._batch, []).append(r.job_id)
    assert sorted(map(sorted, batches.values())) == [[*range(40)], [*range(40, 45)], [*range(45, 75)]]
    root = shared_folder(spark, "t-many").rpartition("/")[0]
    assert max(len(glob.glob(f"{folder}/part-*")) for folder in glob.glob(f"{root}/t-many-*")) == 3 * 8 + 1
