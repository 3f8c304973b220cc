"""Jobs, stored results, routing and streams."""

import json

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import alignment as al, jobs as jb
from cuesheet.sources import jobs as js
from cuesheet.streaming import jobs as sj, words as sw
from cuesheet.streaming.sinks import drain, newest


@pytest.mark.parametrize("raw, name", [("EN", "english"), ("Auto-detect", "auto"), ("pt", "portuguese"),
                                       ("klingon", None)])
def test_languages(spark, raw, name):
    df = spark.createDataFrame([(raw,)], "language string")
    assert jb.canonical_language(df).first().canonical_language == name


@pytest.mark.parametrize("asked, heard, expected", [("auto", "English", True), ("english", None, True),
                                                    ("auto", "Spanish", False), ("spanish", "English", False)])
def test_english_rule(spark, asked, heard, expected):
    df = spark.createDataFrame([(asked, heard)], "a string, b string")
    assert df.select(al.uses_english(F.col("a"), F.col("b"))).first()[0] is expected


ROUTE = ("backend string, requested_language string, detected_language string, source_layer string, "
         "multilingual_ok boolean, has_path boolean, confidence double, coverage double, aligned_text string")


@pytest.mark.parametrize(
    "row, route, confidence",
    [(("ctc", "english", "English", "center", False, False, None, None, ""), "raw", 0.0),
     (("ctc", "english", "English", "side", False, False, None, None, ""), "drop", 0.0),
     (("ctc", "english", "English", "center", False, True, 0.01, 1.0, "sung"), "raw", 0.01),
     (("ctc", "english", "English", "side", False, True, 0.01, 1.0, "maybe"), "drop", 0.01),
     (("ctc", "english", "English", "center", False, True, 0.9, 1.0, "thanks for watching"), "drop", 0.9),
     (("ctc", "english", "English", "center", False, True, 0.9, 1.0, "fine"), "aligned", 0.9),
     (("qwen3", "french", None, "center", True, False, None, None, ""), "multilingual", 1.0),
     (("qwen3", "french", None, "center", False, False, None, None, ""), "raw", 0.0),
     (("none", "english", "English", "center", False, False, None, None, ""), "raw", 1.0)],
)
def test_routes(spark, row, route, confidence):
    df = spark.createDataFrame([row], ROUTE)
    found = al.route_alignment(al.aligner_language(spark, df)).first()
    assert (found.route, found.segment_confidence) == (route, confidence)


@pytest.mark.parametrize("layer", ["center", "side"])
def test_failed_token_alignment_keeps_raw_words(spark, layer):
    row = ("ctc", "english", "English", layer, False, True, 0.9, 1.0, "fine")
    for error, expected in ((True, ("raw", 0.0)), (None, ("aligned", 0.9))):
        df = spark.createDataFrame([(*row, error)], f"{ROUTE}, path_error boolean")
        found = al.route_alignment(al.aligner_language(spark, df)).first()
        assert (found.route, found.segment_confidence) == expected


def test_timestamp_mapping_keeps_display_text(spark):
    raw = spark.createDataFrame(
        [(1, 0, 0, "Hello,", "lead"), (1, 0, 1, "world", "lead")],
        "track_id long, phrase int, pos long, text string, kind string",
    )
    items = spark.createDataFrame(
        [(1, 0, 0, "hello", 0.0, 0.4), (1, 0, 1, "world", 0.4, 0.8)],
        "track_id long, phrase int, pos long, text string, start_time double, end_time double",
    )
    mapped = al.map_timestamps(raw, items).orderBy("pos").collect()
    assert [r.text for r in mapped] == ["Hello,", "world"] and mapped[-1].end == 0.8
    other = items.filter("pos = 0").withColumn("text", F.lit("something"))
    assert al.map_timestamps(raw, other).count() == 0


def test_restore_keeps_actual_models(spark, tmp_path):
    good, text = "a" * 32, "b" * 32
    for job, source in ((good, "source.mp3"), (text, "source.txt")):
        folder = tmp_path / job
        (folder / "separated" / "x").mkdir(parents=True)
        (folder / source).write_bytes(b"1")
        (folder / "separated" / "x" / "vocals.wav").write_bytes(b"1")
        (folder / "job.json").write_text(json.dumps({"schema": 2, "filename": "x.mp3", "quality": "??", "duration": 3}))
        (folder / "inference-result.json").write_text(json.dumps(
            {"ok": True, "words": [{"text": "hi", "start": 0, "end": 1}], "transcription_model": "whisper",
             "alignment_model": "wav2vec2"}))
    rows = js.read_job_results(spark, str(tmp_path)).collect()
    assert [r.job_id for r in rows] == [good]
    assert (rows[0].transcription_model, rows[0].transcription_model_id) == ("whisper", "whisper")
    assert (rows[0].quality, rows[0].language, rows[0].status) == ("accurate", "english", "1 words synced locally")
    assert rows[0].vocal_path.endswith("vocals.wav")


@pytest.mark.parametrize("metadata, restored", [('{"filename": "a', 0), ('{"duration": "long"}', 0), ("{}", 1), (None, 1)])
def test_broken_metadata_is_not_replaced_by_defaults(spark, tmp_path, metadata, restored):
    words = [{"text": "one", "start": 1.0, "end": 1.3}, {"text": "two", "start": 1.4, "end": 1.8}, {"text": "far", "start": 9.0, "end": 9.4}]
    for job, about in (("a" * 32, metadata), ("b" * 32, "{}")):
        folder = tmp_path / job
        folder.mkdir()
        (folder / "source.mp3").write_bytes(b"1")
        (folder / "inference-result.json").write_text(json.dumps({"ok": True, "words": words}))
        if about is not None:
            (folder / "job.json").write_text(about)
    jobs = js.read_job_results(spark, str(tmp_path))
    lines = js.restored_lines(jobs).collect()
    assert sorted(r.job_id for r in jobs.collect()) == ["a" * 32] * restored + ["b" * 32]
    assert sorted((r.job_id[0], r.line_no, len(r.words)) for r in lines if r.job_id[0] == "b") == [("b", 0, 2), ("b", 1, 1)]


def test_passes_do_not_depend_on_block_size(spark):
    percents = [10, 80, 20, 90, 100, 5, 25, 75, 25, 24, 99, 1]
    log = spark.createDataFrame([(job, n, f"{p}%|##") for job in ("x", None) for n, p in enumerate(percents)], "job_id string, seq long, line string")
    log = log.withColumn("passes", F.lit(9).cast("long"))
    expected = [1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5]
    for size in (1, 2, 5, 4096):
        rows = jb.pass_progress(log, lines_per_block=size).collect()
        for job in ("x", None):
            assert [r.pass_no for r in sorted(rows, key=lambda r: r.seq) if r.job_id == job] == expected


def test_only_finished_old_jobs_expire(spark):
    schema = "job_id string, stage string, has_live_work boolean, modified timestamp"
    jobs = spark.sql(
        "SELECT * FROM VALUES ('old', 'complete', false, timestamp'2024-01-01 00:00:00'), "
        "('waiting', 'queued', false, timestamp'2024-01-01 00:00:00') t(job_id, stage, has_live_work, modified)"
    )
    stored = jobs.select("job_id", "modified").unionByName(
        spark.sql("SELECT 'folder' AS job_id, timestamp'2023-01-01 00:00:00' AS modified")
    )
    now = F.lit("2024-01-01 02:00:00").cast("timestamp")
    assert sorted(r.job_id for r in jb.expired(jobs, stored, now, 1).collect()) == ["folder", "old"]


def test_latest_state_over_several_batches(spark, tmp_path):
    events = [("j1", "2024-01-01 00:00:00", "queued", 1.0, "m1"), ("j1", "2024-01-01 00:01:00", "transcribing", 120.0, " "),
              ("j2", "2024-01-01 00:00:30", "queued", 1.0, ""), ("j1", "2024-01-01 00:02:00", "complete", 100.0, "")]
    for i, (job, ts, stage, progress, model) in enumerate(events):
        (tmp_path / f"{i}.json").write_text(json.dumps(
            {"job_id": job, "ts": ts, "stage": stage, "progress": progress, "status": "s", "transcription_model": model}))
    (tmp_path / "bad.json").write_text('{"job_id": ')
    stream = js.read_progress_stream(spark, str(tmp_path), files_per_trigger=1)
    updates = drain(sj.latest_state(stream), "update", "t-latest")
    assert updates.select("_batch").distinct().count() > 1
    state = {r.job_id: r for r in newest(updates, ["job_id"]).collect()}
    assert (state["j1"].stage, state["j1"].transcription_model, state["j2"].stage) == ("complete", "m1", "queued")


def test_latest_state_of_one_batch_is_not_grouped_again(spark, tmp_path):
    from cuesheet.streaming.ordered import STATE_STORE

    rows = [{"job_id": f"j{n % 3}", "ts": f"2024-01-01 00:00:{n:02d}", "stage": "queued", "progress": n, "status": "s",
             "transcription_model": "\u2003m\u00a0 " if n < 3 else "\u2003"} for n in range(9)]
    (tmp_path / "all.json").write_text("\n".join(json.dumps(r) for r in rows) + '\n{"job_id": "j0", "ts"')
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.unset(provider)
    state = sj.latest_state(js.read_progress_stream(spark, str(tmp_path)))
    assert spark.conf.get(provider) == STATE_STORE  # a state for each job does not stay in memory
    last = newest(drain(state, "update", "t-one"), ["job_id"])
    assert "Exchange" not in last._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.job_id, r.progress, r.transcription_model) for r in last.collect()) == [("j0", 6.0, "m"), ("j1", 7.0, "m"), ("j2", 8.0, "m")]


def test_streamed_lines_equal_batch_lines(spark, tmp_path):
    from cuesheet.operators.lines import group_lines

    schema = "track_id long, word_no long, text string, start double, end double, kind string, phrase int"
    rows = [(1, i, "la", i * 0.4, i * 0.4 + (0.2 if i % 5 else 0.35), "lead", i // 6) for i in range(60)]
    rows = [r if r[1] % 9 else (*r[:3], r[3], r[3] + 0.05, *r[5:]) for r in rows]
    closing = [(-1, 0, "end", 4e6, 4e6 + 1, "lead", 0)]
    for n, part in enumerate((rows[:25], rows[25:], closing)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "w"))
    shape = lambda df: sorted((r.start, r.end, len(r.words)) for r in df.filter("track_id = 1").collect())
    streamed = drain(sw.stream_lines(stream), "append", "t-lines")
    assert shape(streamed) == shape(group_lines(spark.createDataFrame(rows, schema)))
