"""Plans hold at scale: hot keys spread, ranks are limited early, ranges hash on buckets."""

import contextlib

import pytest
from pyspark.sql import functions as F

from cuesheet import fixtures
from cuesheet.operators import intervals as iv, jobs as jb
from cuesheet.plans.scan import Running, cut_groups, following, linked_clamp, running, running_clamp, with_block

SF_DIR = "/root/testdata/sf0.001"


@contextlib.contextmanager
def plain_execution(spark):
    """Without adaptive execution, so that small test data keep their partitions."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def hot(spark):
    """One track with a third of all rows."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1).alias("track_id"),
        F.col("id"), (F.col("id") * 0.1).alias("start"), (F.col("id") * 0.1 + 0.25).alias("end"),
    )
    return with_block(rows, F.col("start"), 50.0)


def partitions_of_hot_key(df):
    return df.filter("track_id = 0").select(F.spark_partition_id()).distinct().count()


def test_scans_spread_a_hot_key(spark, hot):
    with plain_execution(spark):
        scanned = running(hot, ["track_id"], ["start", "id"], [Running("n", "count", F.lit(1).cast("long"))])
        assert partitions_of_hot_key(scanned) == 8
        assert scanned.filter("track_id = 0").agg(F.max("n")).first()[0] == 10_000
        grouped = cut_groups(
            hot, ["track_id"], ["start", "id"], ["start", "end"],
            lambda before, row: row["start"] - before["end"] > 0.04, "run",
        )
        assert partitions_of_hot_key(grouped) == 8
        assert grouped.filter("track_id = 0").select("run").distinct().count() == 10_000


def test_next_row_crosses_blocks(spark, hot):
    ahead = following(hot, ["track_id"], ["start", "id"], ["id"], "next").filter("track_id = 0")
    row = ahead.agg(F.count("next").alias("n"), F.max(F.col("next.id") - F.col("id")).alias("d")).first()
    assert (row.n, row.d) == (9_999, 3)


def test_log_tail_limits_before_the_shuffle(spark):
    log = fixtures.job_log(spark, SF_DIR)
    with plain_execution(spark):
        plan = plan_of(jb.log_tail(log))
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_range_joins_hash_on_buckets(spark):
    table = fixtures.intervals(spark, SF_DIR)
    active = iv.active_at(table, fixtures.probes(table), 3600.0)
    merged = iv.merge_intervals(table, "interval_id", 86400.0)
    for plan in (plan_of(active), plan_of(merged)):
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_read_only_the_columns_they_need(spark):
    uploads = fixtures.jobs(spark, SF_DIR).withColumnRenamed("filename", "file_name")
    plan = jb.accepted(jb.admission(uploads)).select("job_no")._jdf.queryExecution().toString()
    assert "o_orderdate" not in plan.split("ReadSchema")[-1]


def test_a_long_interval_does_not_multiply(spark):
    """A year among seconds has two buckets of its own level; short ones keep the narrow buckets."""
    year = 365 * 86400.0
    rows = [(1, i, i * 7.5, i * 7.5 + 1 + i % 40) for i in range(400)] + [
        (1, 400, 3.0, year), (2, 401, 10.0, 10.0), (2, 402, 30.0, 12.0), (2, 403, -5.0, 64.0)]
    points = [(k, t) for k in (1, 2, 3) for t in (-5.0, 0.0, 3.0, 10.0, 63.999, 64.0, 1500.5, year - 1, year)]
    intervals = spark.createDataFrame(rows, "track_id long, id long, start double, end double")
    asked = spark.createDataFrame(points, "track_id long, t double")
    found = iv.active_at(intervals, asked, 1.0)
    assert sorted((r.track_id, r.t, r.id) for r in found.collect()) == sorted(
        (k, t, i) for k, t in points for track, i, start, end in rows if track == k and start <= t < end)


def test_clamps_run_through_long_blocks(spark):
    """One block of 20,000 rows, against the recurrence."""
    limits = [(7 * i % 1000 * 50, 7 * i % 1000 * 50 + i * 13 % 700) for i in range(20_000)]
    df = spark.createDataFrame(
        [(1, 0, i, 5, low, high, i < 19_999) for i, (low, high) in enumerate(limits)],
        "k int, _block long, i long, first long, low long, high long, more boolean")
    found = running_clamp(df, ["k"], ["i"], "first", "low", "high", "more", 46, "x").orderBy("i").collect()
    x, expected = 5, []
    for low, high in limits:
        expected.append(x)
        x = min(high, max(low, x + 46))
    assert [r.x for r in found] == expected


def test_keys_of_one_block_are_solved_in_one_pass(spark):
    """Keys of one block and of several, null keys, and rows that go on in the next Arrow batch, against the recurrence."""
    rows = [(k, i, i % 11 * 100 + i * 17 % 61, f"w{i}") for k, count in ((1, 40), (None, 40), (2, 900), (3, 1)) for i in range(count)]
    df = with_block(spark.createDataFrame(rows, "k int, i long, s long, t string").repartition(5), F.col("i"), 100.0)
    bounds = lambda ahead: (F.coalesce(ahead["s"], F.lit(0)), F.coalesce(ahead["s"] + 60, F.lit(0)))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = linked_clamp(df, ["k"], ["i"], ["s"], "s", bounds, 46, "next", "x").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    expected = []
    for k in (1, None, 2, 3):
        mine = [r for r in rows if r[0] == k]
        x = mine[0][2]
        for row, after in zip(mine, [*mine[1:], None]):
            expected.append((*row, after and after[2], x))
            x = after and min(after[2] + 60, max(after[2], x + 46))
    assert sorted(map(repr, expected)) == sorted(repr((r.k, r.i, r.s, r.t, r.next and r.next.s, r.x)) for r in found)


def test_rows_that_become_many_are_dealt_first(spark):
    """Adaptive execution made one task of all tracks, whose hours or probes then filled that task's memory."""
    from cuesheet import fixtures

    events = spark.range(2000).select((F.col("id") % 400).alias("track_id"), F.col("id").cast("double").alias("start"))
    for many, count in ((fixtures.hours(events), 400 * 720), (fixtures.probes(events), 400 * 120)):
        sizes = [r["count"] for r in many.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == count and len(sizes) > 1 and max(sizes) < count / 2


def test_focus_gathers_no_table_at_the_driver(spark):
    """Block summaries, levels and lines grow with the tracks; adaptive execution broadcast them while they were small when compressed."""
    table = spark.range(900).select(
        (F.col("id") % 30).alias("track_id"), F.col("id").alias("interval_id"),
        F.when(F.col("id") % 5 == 0, "error").otherwise("view").alias("event_type"),
        (F.col("id") * 1000.0).alias("start"), (F.col("id") * 1000.0 + F.col("id") % 7 * 9000.0).alias("end"))
    points = fixtures.probes(table).select("track_id", iv.display_time(F.col("t")).alias("t"))
    found = iv.focus_line(*fixtures.event_lines(table), points, 21600.0, 86400.0)
    assert len(found.collect()) == 30 * 120
    assert "Broadcast" not in plan_of(found)
