"""Streams of job snapshots: latest state, terminal events, retention and backlog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.constants import (
    DEFAULT_CAPACITY, DEFAULT_RETENTION_HOURS, MAX_CAPACITY, MAX_RETENTION_HOURS, MIN_CAPACITY,
    MIN_RETENTION_HOURS, MODEL_FIELDS, TERMINAL_STAGES,
)
from cuesheet.functions.numeric import clamp_progress
from cuesheet.functions.text import strip_space
from cuesheet.streaming.ordered import GROUPS, first_of_each, last_of_sessions, use_disk_state


def latest_state(events: DataFrame, order: Column | None = None) -> DataFrame:
    """Last snapshot of each job; blank model fields leave the earlier value. Update mode.

    Everything is a ``max_by``, so each input partition sends one row per job. A job's state takes some 560 bytes, so the
    states are kept on disk.
    """
    use_disk_state(events.sparkSession)
    models = [c for c in MODEL_FIELDS if c in events.columns]
    # worked out once for each row, before the rows are sorted by job
    rows = events.select(
        "job_id", "ts", (order if order is not None else F.col("ts")).alias("_at"),
        F.struct("stage", clamp_progress(F.col("progress")).alias("progress"), "status", "error").alias("s"),
        *[F.nullif(strip_space(F.col(c)), F.lit("")).alias(c) for c in models],
    )
    return rows.groupBy("job_id").agg(
        F.max_by("s", "_at").alias("s"), F.max("ts").alias("ts"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in models],
    ).select("job_id", "ts", "s.*", *models)


def _hours(hours: int) -> int:
    return max(MIN_RETENTION_HOURS, min(MAX_RETENTION_HOURS, hours)) * 3_600_000


def terminal_once(
    events: DataFrame, delay: str = "1 hour", order: list[str] | None = None, remember_hours: int = 24 * 365,
    groups: int = GROUPS,
) -> DataFrame:
    """(job_id, ts, stage): the first terminal event of each job by event time, ties by ``order``. Append mode.

    It is sent once the watermark has passed it, so an earlier end that arrives later still wins. A job's end is remembered
    for ``remember_hours`` of event time; until then its other ends are dropped. ``groups``: see ``first_of_each``.
    """
    use_disk_state(events.sparkSession)
    ties = order or ["stage"]
    ends = events.filter(F.col("stage").isin(*TERMINAL_STAGES)).withWatermark("ts", delay)
    settled = ends.groupBy("job_id", "ts").agg(F.min_by("stage", F.struct(*ties)).alias("stage"))
    rows = settled.select("job_id", F.unix_micros("ts").alias("at"), "stage")
    return first_of_each(rows, "job_id", "at", remember_hours, groups).select("job_id", F.timestamp_micros("at").alias("ts"), "stage")


def retention_expiries(
    events: DataFrame, hours: int = DEFAULT_RETENTION_HOURS, delay: str = "0 seconds",
    order: list[str] | None = None, remember_hours: int = 24 * 365,
    groups: int = 4 * GROUPS,
) -> DataFrame:
    """(job_id, stage, last_event): jobs whose last event is terminal and lies the retention back, once each. Append mode.

    Events of a job that follow each other within the retention are one session; it ends the job if its last event is
    terminal. Jobs that are not finished stay; an expired one is remembered for ``remember_hours``, in which events that come
    after its end do not bring it back.
    """
    last = last_of_sessions(
        events, "job_id", delay, _hours(hours) * 1000, list(TERMINAL_STAGES), order or ["stage"], remember_hours, groups)
    return last.select("job_id", "stage", F.timestamp_micros("at").alias("last_event"))


def backlog(events: DataFrame, capacity: int = DEFAULT_CAPACITY) -> DataFrame:
    """Busy jobs now: +1 when queued, -1 on the terminal event. Update mode.

    Expects each job's terminal event once (see ``terminal_once``).
    """
    limit = max(MIN_CAPACITY, min(MAX_CAPACITY, capacity))
    delta = F.when(F.col("stage") == "queued", 1).when(
        F.col("stage").isin(*TERMINAL_STAGES), -1
    ).otherwise(0)
    return events.groupBy().agg(F.coalesce(F.sum(delta), F.lit(0)).alias("busy")).select(
        "busy", (F.col("busy") >= limit).alias("is_full")
    )
