"""Queries on job tables and stored jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet import constants as c, fixtures
from cuesheet.catalog import sql
from cuesheet.catalog.registry import query
from cuesheet.functions.text import base_name, extension, safe_title, track_title
from cuesheet.operators import jobs as jb
from cuesheet.plans.session import shared_folder, stage
from cuesheet.sources import jobs as js
from cuesheet.sources.files import write_texts

_LANG = ", ".join(f"('{a}', '{n}')" for n, s in c.LANGUAGE_SPELLINGS.items() for a in s)
_EXT = ", ".join(f"'{e}'" for e in c.AUDIO_EXTENSIONS)
_Q = lambda text: text.replace("'", "''")

JOBS = f"""
jobs AS (
  SELECT o_orderkey AS job_no, lpad(lower(hex(o_orderkey)), 32, '0') AS job_id,
    'Track_' || o_custkey || [' - Artist', '', ' - A - B'][1 + o_orderkey % 3] || '.' || ['mp3', 'WAV', 'txt', 'flac'][1 + o_orderkey % 4] AS filename,
    CASE o_orderstatus WHEN 'F' THEN ['complete', 'error', 'cancelled'][1 + o_orderkey % 3] WHEN 'O' THEN 'queued' ELSE 'transcribing' END AS stage,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'fast' WHEN '2-HIGH' THEN ' Accurate ' WHEN '3-MEDIUM' THEN 'balanced' WHEN '5-LOW' THEN 'turbo' END AS quality,
    ['EN', 'Auto-detect', 'pt', 'klingon', 'français', 'fre'][1 + o_orderkey % 6] AS language,
    o_orderkey % 1300 / 10e0 - 10e0 AS progress, o_totalprice / 40e0 AS duration,
    CAST(floor(o_totalprice * 1200) AS BIGINT) AS bytes, o_orderdate AS created_at,
    ['CUDA out of memory', 'cuda: no kernel image is available', 'Connection reset', 'first line' || chr(10) || 'last line  ', '', 'Download failed'][1 + o_orderkey % 6] AS error,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'log ' || o_orderkey END AS last_log,
    CASE WHEN o_orderkey % 3 = 0 THEN 'lab/asr-small' ELSE '' END AS transcription_model_id,
    o_orderkey % 5 = 0 AS has_vocals
  FROM orders),
langs(alias, canonical_language) AS (VALUES {_LANG}),
named AS (
  SELECT jobs.*, canonical_language, lower(trim(coalesce(quality, 'balanced'))) AS asked
  FROM jobs LEFT JOIN langs ON alias = regexp_replace(lower(language), '[^\\p{{L}}]+', '', 'g'))"""


@query(
    "q_admit",
    f"""WITH {JOBS}
SELECT job_no, CASE
  WHEN asked NOT IN ('fast', 'balanced', 'accurate') THEN 'unknown profile'
  WHEN canonical_language IS NULL THEN 'unsupported language'
  WHEN lower(regexp_extract(filename, '\\.([^.]+)$', 1)) NOT IN ({_EXT}) THEN 'unsupported file type'
  WHEN bytes > 524288000 THEN 'file too large' WHEN bytes <= 0 THEN 'empty file'
  WHEN duration <= 0 THEN 'undecodable audio' WHEN duration > 10800 THEN 'audio too long' END AS rejection
FROM named""",
)
def q_admit(spark, sf_dir):
    uploads = fixtures.jobs(spark, sf_dir).withColumnRenamed("filename", "file_name")
    return jb.admission(uploads).select("job_no", "rejection")


@query(
    "q_language",
    f"""WITH langs(alias, canonical_language) AS (VALUES {_LANG})
SELECT doc_id, lang, canonical_language FROM documents
LEFT JOIN langs ON alias = regexp_replace(lower(lang), '[^\\p{{L}}]+', '', 'g')""",
)
def q_language(spark, sf_dir):
    return jb.canonical_language(fixtures.table(spark, sf_dir, "documents"), "lang").select(
        "doc_id", "lang", "canonical_language"
    )


@query(
    "q_profile",
    f"""WITH {JOBS}
SELECT CASE WHEN asked IN ('fast', 'balanced', 'accurate') THEN asked END AS profile, count(*) AS jobs,
  count(canonical_language) AS known_languages
FROM named GROUP BY 1""",
)
def q_profile(spark, sf_dir):
    named = jb.canonical_profile(jb.canonical_language(fixtures.jobs(spark, sf_dir)))
    return named.groupBy("profile").agg(
        F.count(F.lit(1)).alias("jobs"), F.count("canonical_language").alias("known_languages")
    )


def _shown(spark, sf_dir):
    """All jobs, those of unknown profiles included, plus the columns the public view needs."""
    named = jb.canonical_profile(fixtures.jobs(spark, sf_dir))
    blank = F.lit("")
    return named.withColumn("quality", F.coalesce("profile", "quality")).select(
        "*", F.lit("ready").alias("status"), F.lit("gpu").alias("device"),
        blank.alias("transcription_backend"), blank.alias("transcription_model"),
        blank.alias("alignment_model"), blank.alias("alignment_model_id"),
        F.array(F.col("filename")).alias("words"),
    )


_PROFILES = ", ".join(
    "(" + ", ".join(f"'{_Q(str(v))}'" for v in row) + ")" for row in c.PROFILES
)
_PROFILE_NAMES = ", ".join(c.PROFILE_COLUMNS)


@query(
    "q_public_jobs",
    f"""WITH {JOBS}, p({_PROFILE_NAMES}) AS (VALUES {_PROFILES}),
j AS (
  SELECT named.*, p.*, greatest(0e0, least(100e0, progress)) AS pr,
    coalesce(nullif(transcription_model_id, ''), asr_model) AS mid
  FROM named LEFT JOIN p ON profile = asked)
SELECT job_id, stage, CAST(round_even({sql.rounded('pr', 1)} * 10, 0) AS BIGINT) AS progress_tenths, asked AS quality,
  separation_model, asr_backend AS transcription_backend, split_part(mid, '/', -1) AS transcription_model,
  mid AS transcription_model_id, split_part(aligner_model, '/', -1) AS alignment_model,
  CASE WHEN has_vocals THEN '/api/jobs/' || job_id || '/vocals' END AS vocal_url, stage = 'complete' AS has_words
FROM j""",
)
def q_public_jobs(spark, sf_dir):
    return jb.public_jobs(_shown(spark, sf_dir)).select(
        "job_id", "stage", F.rint(F.col("progress") * 10).cast("long").alias("progress_tenths"),
        "quality", "separation_model", "transcription_backend", "transcription_model",
        "transcription_model_id", "alignment_model", "vocal_url",
        F.col("words").isNotNull().alias("has_words"),
    )


@query(
    "q_model_metadata",
    """SELECT item_id, nullif(trim(m), '') AS transcription_model, CASE WHEN item_id % 3 = 0 THEN 'aligner' END AS alignment_model
FROM (SELECT item_id, CASE item_id % 4 WHEN 0 THEN ' ' || split_part(text, ' ', 1) || ' ' WHEN 1 THEN '   ' END AS m FROM benchmark)""",
)
def q_model_metadata(spark, sf_dir):
    word = F.split_part("text", F.lit(" "), F.lit(1))
    kind = F.col("item_id") % 4
    value = (
        F.when(kind == 0, F.to_json(F.struct(F.concat(F.lit(" "), word, F.lit(" ")).alias("transcription_model"),
                                             F.lit("aligner").alias("alignment_model"))))
        .when(kind == 1, F.lit('{"transcription_model": "   ", "alignment_model": "aligner"}'))
        .when(kind == 2, F.lit('{"transcription_model": 123, "alignment_model": "aligner"}'))
        .otherwise(F.lit('{"alignment_model": "aligner"}'))
    )
    payloads = fixtures.table(spark, sf_dir, "benchmark").select(
        "item_id", F.try_parse_json(F.when(F.col("item_id") % 3 == 0, value).otherwise(
            F.replace(value, F.lit('"aligner"'), F.lit("null")))).alias("payload"),
    )
    return jb.clean_model_metadata(payloads).select(
        "item_id", "transcription_model", "alignment_model"
    )


@query(
    "q_provenance",
    f"""WITH {JOBS}, p({_PROFILE_NAMES}) AS (VALUES {_PROFILES})
SELECT job_id, label, separation_model, asr_model AS requested_transcription_model_id,
  CASE WHEN stage = 'complete' THEN transcription_model_id END AS transcription_model_id
FROM named LEFT JOIN p ON profile = asked""",
)
def q_provenance(spark, sf_dir):
    named = jb.canonical_profile(fixtures.jobs(spark, sf_dir)).withColumn("quality", F.col("profile"))
    none = F.lit(None).cast("string")
    results = named.filter(F.col("stage") == "complete").select(
        "job_id", "transcription_model_id", none.alias("transcription_backend"),
        none.alias("transcription_model"), none.alias("alignment_model"), none.alias("alignment_model_id"),
    )
    return jb.provenance(named.drop("transcription_model_id"), results).select(
        "job_id", "label", "separation_model", "requested_transcription_model_id", "transcription_model_id"
    )


@query(
    "q_failure",
    f"""WITH {JOBS}, e AS (SELECT *, trim(error) AS raw, lower(trim(error)) AS low FROM jobs)
SELECT job_id, CASE
  WHEN contains(low, 'out of memory') THEN '{_Q(c.FAILURE_MEMORY)}'
  WHEN contains(low, 'cuda') AND (contains(low, 'not available') OR contains(low, 'no kernel image')) THEN '{_Q(c.FAILURE_CUDA)}'
  WHEN contains(low, 'connection') OR contains(low, 'download') THEN '{_Q(c.FAILURE_DOWNLOAD)}'
  WHEN raw <> '' THEN split_part(raw, chr(10), -1)
  ELSE coalesce(last_log, '{_Q(c.FAILURE_UNKNOWN)}') END AS message
FROM e""",
)
def q_failure(spark, sf_dir):
    return jb.classify_failure(fixtures.jobs(spark, sf_dir)).select("job_id", "message")


_NOW = "2000-06-01 00:00:00"


@query(
    "q_expired",
    f"""WITH {JOBS}, b AS (SELECT *, stage NOT IN ('complete', 'error', 'cancelled') AS busy FROM jobs)
SELECT job_id FROM b WHERE NOT busy AND created_at < TIMESTAMP '{_NOW}' - INTERVAL 720 HOUR
UNION
SELECT lpad(lower(hex(l_orderkey)), 32, '0') FROM lineitem
WHERE l_shipdate < TIMESTAMP '{_NOW}' - INTERVAL 720 HOUR
  AND lpad(lower(hex(l_orderkey)), 32, '0') NOT IN (SELECT job_id FROM b WHERE busy)""",
)
def q_expired(spark, sf_dir):
    registry = fixtures.jobs(spark, sf_dir).select(
        "job_id", "stage", F.lit(False).alias("has_live_work"), F.col("created_at").alias("modified")
    )
    stored = fixtures.table(spark, sf_dir, "lineitem").select(
        F.lpad(F.lower(F.hex("l_orderkey")), 32, "0").alias("job_id"),
        F.col("l_shipdate").cast("timestamp").alias("modified"),
    )
    return jb.expired(registry, stored, F.lit(_NOW).cast("timestamp"), 5000)


@query(
    "q_busy",
    f"""WITH {JOBS}
SELECT count(*) FILTER (stage NOT IN ('complete', 'error', 'cancelled') OR job_no % 10 = 0) + 3 AS busy FROM jobs""",
)
def q_busy(spark, sf_dir):
    latest = fixtures.jobs(spark, sf_dir).withColumn("has_live_work", F.col("job_no") % 10 == 0)
    return jb.busy_count(latest, 3)


@query(
    "q_latest",
    """SELECT l_orderkey AS job_id, arg_max(p, struct_pack(m := l_shipdate, p := p)) AS vocal_path
FROM (SELECT *, 'out/' || l_suppkey || '/' || l_linenumber || '/vocals.wav' AS p FROM lineitem) GROUP BY 1""",
)
def q_latest(spark, sf_dir):
    files = fixtures.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.concat_ws("/", F.lit("out"), "l_suppkey", "l_linenumber", F.lit("vocals.wav")).alias("path"),
        F.col("l_shipdate").alias("modified"),
    )
    return jb.latest_vocals(files)


LOG = """
items AS (
  SELECT l_orderkey AS job_id, (CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 2000 + l_suppkey * 2 AS base, l_suppkey AS s,
         CAST(l_quantity * 2 AS INT) AS q FROM lineitem),
log AS (
  SELECT job_id, base AS seq, 'separating ' || q || '% done' AS line, q FROM items
  UNION ALL
  SELECT job_id, base + 1, CASE WHEN s % 3 = 0 THEN '' ELSE 'note ' || s END, NULL FROM items)"""


@query(
    "q_log_tail",
    f"""WITH {LOG}
SELECT job_id, seq, line FROM log WHERE line <> ''
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) <= 24""",
)
def q_log_tail(spark, sf_dir):
    return jb.log_tail(fixtures.job_log(spark, sf_dir)).select("job_id", "seq", "line")


@query(
    "q_pass_progress",
    f"""WITH {LOG},
r AS (SELECT *, least(100, q) AS pc, lag(least(100, q)) OVER (PARTITION BY job_id ORDER BY seq) AS pb FROM log WHERE q IS NOT NULL),
p AS (SELECT *, least(3, sum(CASE WHEN pb >= 75 AND pc <= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq)) AS cur FROM r)
SELECT job_id, seq, CAST(cur + 1 AS BIGINT) AS pass_no,
  CAST(round_even(least(55e0, 8e0 + (cur * 100 + pc) / 400e0 * 47e0) * 1e4, 0) AS BIGINT) AS progress_x FROM p""",
)
def q_pass_progress(spark, sf_dir):
    log = fixtures.job_log(spark, sf_dir).withColumn("passes", F.lit(4).cast("long"))
    return jb.pass_progress(log, lines_per_block=4e9).select(
        "job_id", "seq", "pass_no", F.rint(F.col("progress") * 1e4).cast("long").alias("progress_x")
    )


@query(
    "q_titles",
    f"""WITH {JOBS},
t AS (SELECT job_id, trim(regexp_replace(regexp_replace(filename, '\\.[^.]+$', ''), '_+', ' ', 'g')) AS clean FROM jobs),
p AS (SELECT *, regexp_split_to_array(clean, '\\s+-\\s+') AS parts FROM t)
SELECT job_id, CASE WHEN len(parts) > 1 THEN parts[1] ELSE clean END AS title,
  CASE WHEN len(parts) > 1 THEN array_to_string(parts[2:], ' — ') ELSE 'Local audio' END AS artist,
  regexp_replace(regexp_replace(CASE WHEN len(parts) > 1 THEN parts[1] ELSE clean END, '[^a-zA-Z0-9_-]+', '-', 'g'), '^-|-$', '', 'g') AS safe
FROM p""",
)
def q_titles(spark, sf_dir):
    named = fixtures.jobs(spark, sf_dir).select("job_id", track_title(F.col("filename")).alias("t"))
    return named.select("job_id", "t.title", "t.artist", safe_title(F.col("t.title")).alias("safe"))


@query(
    "q_manifest",
    """SELECT page_id, 'txt' AS extension, CAST(strlen(html) + 1 AS BIGINT) AS bytes FROM pages""",
)
def q_manifest(spark, sf_dir):
    folder = shared_folder(spark, "uploads")
    pages = fixtures.table(spark, sf_dir, "pages").select(
        (F.col("page_id") % 256).alias("shelf"), "page_id", F.col("html").alias("value"))
    write_texts(pages, folder, ["shelf"], "page_id")
    found = js.scan_manifest(spark, folder, recursive=True)
    return found.select(
        F.regexp_extract("path", r"page_id=(\d+)", 1).cast("long").alias("page_id"), "extension", "bytes"
    )


@query(
    "q_restore",
    f"""WITH RECURSIVE {sql.LINE_STEPS},
per_track AS (SELECT track_id, count(*) AS n_lines, {sql.ms('max("end")')} AS last_ms FROM lines GROUP BY track_id)
SELECT lpad(lower(hex(track_id)), 32, '0') AS job_id, any_value(n_lines) AS n_lines, any_value(last_ms) AS last_ms, count(*) || ' words synced locally' AS status,
  CASE track_id % 4 WHEN 0 THEN 'fast' ELSE 'accurate' END AS quality,
  CASE track_id % 3 WHEN 0 THEN 'spanish' ELSE 'english' END AS language, 'asr-' || track_id % 2 AS transcription_model_id,
  CAST(sum({sql.ms('"end" - start')}) AS BIGINT) AS sung_ms
FROM words JOIN per_track USING (track_id) WHERE track_id % 10 <> 9 AND track_id % 8 <> 5 AND track_id % 7 <> 3 GROUP BY track_id""",
)
def q_restore(spark, sf_dir):
    """Results and metadata are written as one JSON file per job and restored from there, with
    lines; some metadata files are cut off, and their jobs do not come back."""
    words = fixtures.words(spark, sf_dir)
    item = F.struct("word_no", "text", "start", "end", "kind", "phrase")
    grouped = words.groupBy("track_id").agg(F.array_sort(F.collect_list(item)).alias("words"))
    job = F.lpad(F.lower(F.hex("track_id")), 32, "0")
    result = F.struct(
        (F.col("track_id") % 10 != 9).alias("ok"),
        F.transform("words", lambda w: w.dropFields("word_no")).alias("words"),
        F.concat(F.lit("asr-"), (F.col("track_id") % 2).cast("string")).alias("transcription_model"),
    )
    about = F.struct(
        F.lit(2).alias("schema"), F.concat(F.lit("t"), F.col("track_id"), F.lit(".mp3")).alias("filename"),
        F.when(F.col("track_id") % 4 == 0, "fast").when(F.col("track_id") % 4 == 1, "??").alias("quality"),
        F.when(F.col("track_id") % 3 == 0, "ES").alias("language"), F.lit(12.5).alias("duration"),
    )
    folder = shared_folder(spark, "restore")
    documents = grouped.select(
        F.pmod(F.xxhash64("track_id"), F.lit(256)).alias("shelf"), job.alias("job_id"), F.explode(F.create_map(
            F.lit("result"), F.to_json(result), F.lit("job"), F.when(F.col("track_id") % 7 == 3, '{"schema": 2, "filename": "t').otherwise(F.to_json(about)))).alias("document", "value")
    )
    write_texts(documents, folder, ["document", "shelf"], "job_id")
    sources = grouped.select(
        job.alias("job_id"), F.lit("source").alias("file_name"),
        F.when(F.col("track_id") % 8 == 5, "txt").otherwise("mp3").alias("extension"),
    )
    restored = stage(js.restore_jobs(
        js.read_documents(spark, f"{folder}/document=result", js.RESULT_SCHEMA, recursive=True),
        js.read_metadata(spark, f"{folder}/document=job", recursive=True), sources,
    ), "restored")
    lines = js.restored_lines(restored).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.rint(F.max("end") * 1000).cast("long").alias("last_ms"))
    length = F.aggregate(
        "words", F.lit(0).cast("long"),
        lambda a, w: a + F.rint((w["end"] - w["start"]) * 1000).cast("long"),
    )
    return restored.join(lines, "job_id").select(
        "job_id", "n_lines", "last_ms", "status", "quality", "language", "transcription_model_id", length.alias("sung_ms")
    )
