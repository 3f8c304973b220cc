"""Streaming queries, run over all available input, and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet import fixtures
from cuesheet.catalog import sql
from cuesheet.catalog.cleaning import q_dedup  # noqa: F401  (registers the SQL twin used below)
from cuesheet.catalog.lines import line_rows
from cuesheet.catalog.registry import ORACLES, query
from cuesheet.functions.numeric import to_ms
from cuesheet.operators import intervals as iv
from cuesheet.plans.session import shared_folder, stage
from cuesheet.sources import jobs as js, timings as tm
from cuesheet.streaming import jobs as sj, words as sw
from cuesheet.streaming.sinks import drain, newest

DAY = 86400.0
#: Hours; the tables spread the events of a job over years.
TEN_YEARS = 24 * 3653


def _table_stream(spark, sf_dir, name):
    """A table of the data folder as a file stream."""
    schema = fixtures.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _job_events(spark, sf_dir):
    """Line items as snapshots of their order's job."""
    items = _table_stream(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    return items.select(
        key.alias("job_id"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"),
        F.when(F.col("l_linestatus") == "F", F.when(key % 2 == 0, "complete").otherwise("error"))
        .otherwise("transcribing").alias("stage"),
        (F.col("l_quantity") * 3 - 10).alias("progress"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("status"),
        F.lit("").alias("error"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit(" m"), F.col("l_suppkey").cast("string")))
        .otherwise(" ").alias("transcription_model"),
    )


_EVENTS = """
e AS (
  SELECT l_orderkey AS job_id, l_shipdate AS ts,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn,
    CASE WHEN l_linestatus = 'F' THEN CASE l_orderkey % 2 WHEN 0 THEN 'complete' ELSE 'error' END ELSE 'transcribing' END AS stage,
    greatest(0, least(100, l_quantity * 3 - 10)) AS progress, 'part ' || l_partkey AS status,
    CASE WHEN l_returnflag = 'A' THEN 'm' || l_suppkey END AS model
  FROM lineitem)"""


@query(
    "s_latest",
    f"""WITH {_EVENTS}
SELECT job_id, arg_max(stage, rn) AS stage, CAST(arg_max(progress, rn) AS BIGINT) AS progress,
  arg_max(status, rn) AS status, arg_max(model, rn) FILTER (model IS NOT NULL) AS transcription_model
FROM e GROUP BY job_id""",
)
def s_latest(spark, sf_dir):
    state = sj.latest_state(_job_events(spark, sf_dir), F.col("at"))
    return newest(drain(state, "update", "latest"), ["job_id"]).select(
        "job_id", "stage", F.col("progress").cast("long").alias("progress"), "status",
        "transcription_model",
    )


def _arriving(spark, events, name, days=1300, late=20, rows_per_file=1_000_000):
    """Events in several micro-batches of ``days`` each, every event up to ``late`` days late. A last event far in the future
    lets the watermark pass all others. The largest batch has files of some ``rows_per_file``, which tasks of their own write and read."""
    folder = shared_folder(spark, name)
    days_on = F.datediff("ts", F.lit("1992-01-01")) + F.pmod(F.xxhash64("job_id", "ts"), F.lit(late))
    marked = stage(events.withColumn("slice", F.floor(days_on / days).cast("int")), name)
    last = spark.range(1).select(*[
        (F.lit(-1) if f.name == "job_id" else F.lit("2200-01-01").cast("timestamp") if f.name == "ts" else F.lit("complete") if f.name == "stage" else F.lit(0))
        .cast(f.dataType).alias(f.name) for f in events.schema])
    counts = {r["slice"]: r["count"] for r in marked.filter("slice is not null").groupBy("slice").count().collect()}
    files = max(1, -(-max(counts.values(), default=0) // rows_per_file))
    for done, number in enumerate(sorted(counts), 1):
        marked.filter(F.col("slice") == number).drop("slice").coalesce(files).write.mode("append").parquet(folder)
        # a batch is so many files, so a slice that made fewer gets empty ones
        for _ in range(done * files - len(spark.read.schema(events.schema).parquet(folder).inputFiles())):
            last.limit(0).coalesce(1).write.mode("append").parquet(folder)
    last.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _mixed_ends(spark, sf_dir):
    """Line items as job events: a job can end several times, with different stages, in mixed order."""
    items = fixtures.table(spark, sf_dir, "lineitem")
    number, status = F.col("l_linenumber"), F.col("l_linestatus")
    return items.select(
        F.col("l_orderkey").alias("job_id"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.when((number % 3 != 0) | (status == "F"), F.when(number % 2 == 0, "complete").otherwise("error")).otherwise("transcribing").alias("stage"),
        number.alias("no"),
    )


_MIXED = """
e AS (SELECT l_orderkey AS job_id, l_shipdate AS ts, l_linenumber AS no,
        CASE WHEN l_linenumber % 3 <> 0 OR l_linestatus = 'F' THEN CASE l_linenumber % 2 WHEN 0 THEN 'complete' ELSE 'error' END ELSE 'transcribing' END AS stage
      FROM lineitem)"""


@query(
    "s_terminal",
    f"""WITH {_MIXED}
SELECT job_id, arg_min(stage, struct_pack(t := ts, n := no, s := stage)) AS stage, CAST(epoch_us(min(ts)) // 1000000 AS BIGINT) AS ended
FROM e WHERE stage <> 'transcribing' GROUP BY job_id""",
)
def s_terminal(spark, sf_dir):
    """Ends of a job arrive late and out of order; the first by event time is the one that counts."""
    stream = _arriving(spark, _mixed_ends(spark, sf_dir), "ends")
    found = drain(sj.terminal_once(stream, "30 days", ["no", "stage"], TEN_YEARS), "append", "terminal").filter("job_id >= 0")
    return found.select("job_id", "stage", F.unix_seconds("ts").alias("ended"))


@query(
    "s_retention",
    f"""WITH {_MIXED},
g AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, no, stage) AS next,
             row_number() OVER (PARTITION BY job_id ORDER BY ts, no, stage) AS rn FROM e)
SELECT job_id, arg_min(stage, rn) AS stage, CAST(epoch_us(min(ts)) // 1000000 AS BIGINT) AS last_event
FROM g WHERE stage <> 'transcribing' AND (next IS NULL OR next > ts + INTERVAL 720 HOUR) GROUP BY job_id""",
)
def s_retention(spark, sf_dir):
    """Jobs expire once, thirty days after an end that no event of theirs followed in time."""
    stream = _arriving(spark, _mixed_ends(spark, sf_dir), "expiring")
    found = drain(sj.retention_expiries(stream, 720, "30 days", ["no", "stage"], TEN_YEARS), "append", "retention").filter("job_id >= 0")
    return found.select("job_id", "stage", F.unix_seconds("last_event").alias("last_event"))


@query(
    "s_backlog",
    """SELECT CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 WHEN o_orderstatus = 'F' THEN -1 ELSE 0 END) AS BIGINT) AS busy,
  sum(CASE WHEN o_orderstatus = 'O' THEN 1 WHEN o_orderstatus = 'F' THEN -1 ELSE 0 END) >= 4 AS is_full FROM orders""",
)
def s_backlog(spark, sf_dir):
    events = _table_stream(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "complete")
        .otherwise("transcribing").alias("stage"),
    )
    updates = drain(sj.backlog(events, 4), "update", "backlog").withColumn("all", F.lit(0))
    return newest(updates, ["all"]).drop("all")


@query(
    "s_snapshots",
    """WITH e AS (
  SELECT l_orderkey AS job_id, CASE WHEN l_linestatus = 'F' THEN 'complete' ELSE 'transcribing' END AS stage,
    greatest(0, least(100, l_quantity * 3 - 10)) AS progress, 'part ' || l_partkey AS status, l_suppkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, 'part ' || l_partkey, l_quantity, l_suppkey) AS rn, l_returnflag
  FROM lineitem WHERE l_linenumber <> 3)
SELECT lpad(lower(hex(job_id)), 32, '0') AS job_id, arg_max(stage, rn) AS stage, CAST(arg_max(progress, rn) AS BIGINT) AS progress,
  arg_max(status, rn) AS status, arg_max('m' || l_suppkey, rn) FILTER (l_returnflag = 'A') AS transcription_model
FROM e GROUP BY 1""",
)
def s_snapshots(spark, sf_dir):
    """Snapshots are written as JSON lines, some of them cut off, and streamed from there."""
    snapshot = F.to_json(F.struct(
        F.lpad(F.lower(F.hex("l_orderkey")), 32, "0").alias("job_id"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.when(F.col("l_linestatus") == "F", "complete").otherwise("transcribing").alias("stage"),
        (F.col("l_quantity") * 3 - 10).alias("progress"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("status"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit(" m"), F.col("l_suppkey").cast("string"))).alias("transcription_model"),
        F.lpad(F.col("l_suppkey").cast("string"), 10, "0").alias("alignment_model"),
    ))
    cut = F.when(F.col("l_linenumber") == 3, F.substring(snapshot, 1, 60)).otherwise(snapshot)
    folder = shared_folder(spark, "snapshots")
    fixtures.table(spark, sf_dir, "lineitem").select(cut.alias("value")).write.text(folder)
    stream = js.read_progress_stream(spark, folder)
    state = sj.latest_state(stream, F.struct("ts", "status", "progress", "alignment_model"))
    return newest(drain(state, "update", "snapshot-state"), ["job_id"]).select(
        "job_id", "stage", F.col("progress").cast("long").alias("progress"), "status", "transcription_model"
    )


@query(
    "s_queue",
    """WITH t AS (SELECT count(DISTINCT l_orderkey) AS ended FROM lineitem WHERE l_linestatus = 'F'),
q AS (SELECT count(*) AS queued FROM orders)
SELECT CAST(queued - ended AS BIGINT) AS busy, queued - ended >= 4 AS is_full FROM q, t""",
)
def s_queue(spark, sf_dir):
    """Every order is queued once and may end several times; only its first end is taken off the backlog.

    Both steps keep state, so the terminal events pass through a table."""
    events = fixtures.table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.lit("complete").alias("stage"))
    terminal = sj.terminal_once(_arriving(spark, events, "queue-ends"), "30 days", remember_hours=TEN_YEARS)
    folder = shared_folder(spark, "ended")
    ended = drain(terminal, "append", "terminal").filter("job_id >= 0").select("job_id", "ts", "stage")
    ended.write.parquet(folder)
    queued = _table_stream(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("queued").alias("stage"))
    events = queued.unionByName(spark.readStream.schema(ended.schema).parquet(folder))
    updates = drain(sj.backlog(events, 4), "update", "queue").withColumn("all", F.lit(0))
    return newest(updates, ["all"]).drop("all")


@query("s_sync", ORACLES["q_focus"])
def s_sync(spark, sf_dir):
    intervals = fixtures.intervals(spark, sf_dir)
    words, lines = fixtures.event_lines(intervals)
    positions = stage(
        fixtures.probes(intervals).withColumnRenamed("t", "audio_time"), "positions"
    )
    folder = shared_folder(spark, "positions")
    positions.write.parquet(folder)
    stream = spark.readStream.schema(positions.schema).parquet(folder)
    sync = sw.live_sync(words, lines, 3600.0 * 6, DAY)
    return drain(stream, "append", "sync", sync).select(
        "track_id", to_ms(F.col("t")).alias("t_ms"), "source", "focus_line"
    )


def _word_stream(spark, words):
    """Stored words as a stream; a last word far in the future closes every session."""
    folder = shared_folder(spark, "word-stream")
    closing = {"track_id": F.lit(-1), "start": F.lit(4e9), "end": F.lit(4e9 + 1), "text": F.lit("end")}
    last = spark.range(1).select(
        *[
            closing.get(f.name, F.lit("lead") if f.name == "kind" else F.lit(0)).cast(f.dataType).alias(f.name)
            for f in words.schema
        ]
    )
    words.unionByName(last).write.parquet(folder)
    return spark.readStream.schema(words.schema).parquet(folder)


@query(
    "s_lines",
    f"""WITH RECURSIVE {sql.LINE_STEPS}
SELECT track_id, kind, {sql.ms('start')} AS start_ms, {sql.ms('"end"')} AS end_ms, n_words FROM lines""",
)
def s_lines(spark, sf_dir):
    stream = _word_stream(spark, fixtures.words(spark, sf_dir))
    lines = drain(sw.stream_lines(stream), "append", "stream-lines")
    return lines.filter(F.col("track_id") >= 0).select(
        "track_id", "kind", to_ms(F.col("start")).alias("start_ms"),
        to_ms(F.col("end")).alias("end_ms"), F.size("words").cast("long").alias("n_words"),
    )


@query("s_dedup", ORACLES["q_dedup"])
def s_dedup(spark, sf_dir):
    stream = _word_stream(spark, fixtures.beats(spark, sf_dir))
    kept = drain(sw.stream_dedup(stream), "append", "stream-dedup")
    return kept.filter(F.col("track_id") >= 0).select(
        "track_id", "word_no", to_ms(F.col("end")).alias("end_ms")
    )


@query(
    "q_lrc",
    f"""WITH RECURSIVE {sql.LINE_STEPS},
x AS (SELECT *, start - floor(start / 60) * 60 AS rest FROM lines),
y AS (SELECT *, CASE WHEN rest * 8 = floor(rest * 8) THEN floor(rest * 100 + 0.5e0) / 100
             ELSE {sql.rounded('rest', 2)} END AS r2 FROM x)
SELECT track_id, line_no, '[' || lpad(CAST(CAST(floor(start / 60) AS BIGINT) AS VARCHAR),
    CAST(greatest(2, length(CAST(CAST(floor(start / 60) AS BIGINT) AS VARCHAR))) AS INT), '0') || ':' || printf('%05.2f', r2) || ']' || line_text AS value
FROM y""",
)
def q_lrc(spark, sf_dir):
    """Lyric files are written and read back whole; a line's number is its place in its track's file."""
    folder = shared_folder(spark, "lrc")
    lines = stage(line_rows(spark, sf_dir), "numbered")
    tm.write_lrc(lines, folder)
    files = spark.read.text(folder, wholetext=True)
    return files.select(
        F.col("track_id").cast("long").alias("track_id"),
        F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line_no", "value"),
    ).withColumn("line_no", F.col("line_no").cast("long"))


@query(
    "q_export_json",
    f"""WITH RECURSIVE {sql.LINE_STEPS}
SELECT track_id, 'word-timings.v1' AS schema_id, TRUE AS processing_is_null, count(*) AS n_lines,
  CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum({sql.ms('"end" - start')}) AS BIGINT) AS sung_ms,
  arg_min(line_text, line_no) AS first_line
FROM lines GROUP BY track_id""",
)
def q_export_json(spark, sf_dir):
    """Export documents are written and parsed again."""
    lines = stage(line_rows(spark, sf_dir), "numbered")
    tracks = lines.select("track_id").distinct().select(
        "track_id", F.concat(F.lit("Track "), F.col("track_id").cast("string")).alias("title"),
        F.lit("Local audio").alias("artist"), F.lit(240.0).alias("duration"),
        F.lit(None).cast("struct<quality:string,language:string>").alias("processing"),
    )
    documents = tm.timing_documents(lines, tracks, "word-timings.v1", F.lit("2024-01-01T00:00:00Z"))
    folder = shared_folder(spark, "export")
    tm.write_timing_export(documents, folder)
    back = spark.read.text(folder, wholetext=True).select(
        F.col("track_id").cast("long").alias("track_id"), F.parse_json("value").alias("d")
    )
    shape = "array<struct<start:double,end:double,words:array<struct<text:string>>>>"
    parsed = back.select(
        "track_id", F.variant_get("d", "$.schema", "string").alias("schema_id"),
        F.is_variant_null(F.variant_get("d", "$.processing", "variant")).alias("processing_is_null"),
        F.variant_get("d", "$.lines", shape).alias("lines"),
    )
    milliseconds = lambda l: F.rint((l["end"] - l["start"]) * 1000).cast("long")
    return parsed.select(
        "track_id", "schema_id", "processing_is_null", F.size("lines").cast("long").alias("n_lines"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, l: a + F.size(l["words"])).alias("n_words"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, l: a + milliseconds(l)).alias("sung_ms"),
        F.array_join(F.transform(F.get("lines", F.lit(0))["words"], lambda w: w["text"]), " ").alias("first_line"),
    )
