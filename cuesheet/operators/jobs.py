"""Job tables: admission, profiles, public view, failures, retention, logs and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cuesheet.constants import (
    AUDIO_EXTENSIONS, DEFAULT_PROFILE, DEFAULT_RETENTION_HOURS, FAILURE_CUDA, FAILURE_DOWNLOAD,
    FAILURE_MEMORY, FAILURE_UNKNOWN, LANGUAGE_SPELLINGS, LOG_TAIL_LINES, MAX_DURATION_SECONDS,
    MAX_RETENTION_HOURS, MAX_UPLOAD_BYTES, MIN_RETENTION_HOURS, MODEL_FIELDS, PROFILE_COLUMNS,
    PROFILES, TERMINAL_STAGES,
)
from cuesheet.functions.numeric import clamp_progress, round_exact
from cuesheet.functions.text import extension, letters_only, short_model, strip_ansi, strip_space
from cuesheet.plans.scan import counted_steps, with_block
from cuesheet.plans.session import constant_table

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def profiles(spark: SparkSession) -> DataFrame:
    """The three processing profiles, as a constant dimension."""
    types = {"passes": "int", "side_pass": "boolean"}
    schema = ", ".join(f"{c} {types.get(c, 'string')}" for c in PROFILE_COLUMNS)
    return constant_table(spark, list(PROFILES), schema)


def languages(spark: SparkSession) -> DataFrame:
    rows = [(a, name) for name, spellings in LANGUAGE_SPELLINGS.items() for a in spellings]
    return constant_table(spark, rows, "alias string, canonical_language string")


def canonical_language(df: DataFrame, language: str = "language") -> DataFrame:
    """Adds ``canonical_language``; null where the name is not known."""
    dim = languages(df.sparkSession)
    return df.withColumn("_alias", letters_only(F.col(language))).join(
        dim.withColumnRenamed("alias", "_alias"), "_alias", "left"
    ).drop("_alias")


def canonical_profile(df: DataFrame, quality: str = "quality") -> DataFrame:
    """Adds ``profile``; a missing name takes the default, an unknown one gives null."""
    dim = profiles(df.sparkSession).select("profile")
    asked = F.lower(strip_space(F.coalesce(F.col(quality), F.lit(DEFAULT_PROFILE))))
    return df.withColumn("_asked", asked).join(
        dim, F.col("_asked") == F.col("profile"), "left"
    ).drop("_asked")


def admission(uploads: DataFrame) -> DataFrame:
    """Adds the first ``rejection`` that applies (null = accepted).

    ``uploads`` has file_name, bytes, duration, quality and language.
    """
    named = canonical_profile(canonical_language(uploads))
    ext = extension(F.col("file_name"))
    seconds = F.col("duration")
    reason = (
        F.when(F.col("profile").isNull(), "unknown profile")
        .when(F.col("canonical_language").isNull(), "unsupported language")
        .when(~ext.isin(*AUDIO_EXTENSIONS), "unsupported file type")
        .when(F.col("bytes") > MAX_UPLOAD_BYTES, "file too large")
        .when(F.col("bytes") <= 0, "empty file")
        .when(
            seconds.isNull() | F.isnan(seconds) | (seconds <= 0) | (seconds == float("inf")),
            "undecodable audio",
        )
        .when(seconds > MAX_DURATION_SECONDS, "audio too long")
    )
    return named.withColumn("rejection", reason)


def accepted(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("rejection").isNull()).drop("rejection")


def rejected(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("rejection").isNotNull())


def clean_model_metadata(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The five model fields of a VARIANT payload: non-blank strings, trimmed, else null."""

    def field(name: str) -> Column:
        raw = F.try_variant_get(F.col(payload), f"$.{name}", "variant")
        is_string = F.coalesce(F.schema_of_variant(raw) == "STRING", F.lit(False))
        return F.nullif(
            strip_space(F.when(is_string, F.variant_get(raw, "$", "string"))), F.lit("")
        ).alias(name)

    return df.select(*[c for c in df.columns if c != payload], *[field(n) for n in MODEL_FIELDS])


def public_jobs(jobs: DataFrame) -> DataFrame:
    """The view shown to clients: actual models before configured ones, results when complete.

    A job of an unknown profile stays, with null configured models and the fault in ``error``."""
    dim = profiles(jobs.sparkSession)
    joined = jobs.join(dim.withColumnRenamed("profile", "quality"), "quality", "left").withColumn(
        "error", F.coalesce("error", F.when(F.col("label").isNull(), F.concat(
            F.lit("unknown profile: "), F.coalesce("quality", F.lit("none"))))))
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    asr_id = F.coalesce(given("transcription_model_id"), "asr_model")
    align_id = F.coalesce(given("alignment_model_id"), "aligner_model")
    done = F.col("stage") == "complete"
    results = [
        F.when(done, F.col(c)).alias(c) for c in ("words", "lines") if c in jobs.columns
    ]
    return joined.withColumn("_progress", clamp_progress(F.col("progress"))).select(
        "job_id", "filename", "stage", round_exact(F.col("_progress"), 1).alias("progress"),
        "status", "error", "duration", "quality", "language", "device",
        F.col("separation_model"),
        F.coalesce(given("transcription_backend"), "asr_backend").alias("transcription_backend"),
        F.coalesce(given("transcription_model"), short_model(asr_id)).alias("transcription_model"),
        asr_id.alias("transcription_model_id"),
        F.coalesce(given("alignment_model"), short_model(align_id)).alias("alignment_model"),
        align_id.alias("alignment_model_id"),
        F.col("aligner_model").alias("alignment_model_requested"), "created_at",
        F.when(
            F.col("vocal_path").isNotNull(),
            F.concat(F.lit("/api/jobs/"), F.col("job_id"), F.lit("/vocals")),
        ).alias("vocal_url"),
        *results,
    )


def provenance(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Requested and actual models of each job, for exports."""
    actual = results.select("job_id", *MODEL_FIELDS)
    dim = profiles(jobs.sparkSession).select(
        F.col("profile").alias("quality"), "label", "separation_model",
        F.col("asr_model").alias("requested_transcription_model_id"),
        F.col("aligner_model").alias("requested_alignment_model_id"),
    )
    return jobs.join(actual, "job_id", "left").join(dim, "quality", "left")


def classify_failure(failures: DataFrame) -> DataFrame:
    """Adds ``message`` from ``error`` and ``last_log`` by ordered rules."""
    raw = strip_space(F.coalesce("error", F.lit("")))
    low = F.lower(raw)
    has = lambda text: F.contains(low, F.lit(text))
    last_line = F.element_at(F.split(raw, LINE_BREAK), -1)
    message = (
        F.when(has("out of memory"), FAILURE_MEMORY)
        .when(has("cuda") & (has("not available") | has("no kernel image")), FAILURE_CUDA)
        .when(has("connection") | has("download"), FAILURE_DOWNLOAD)
        .when(raw != "", F.substring(last_line, 1, 360))
        .otherwise(F.coalesce(F.substring("last_log", 1, 360), F.lit(FAILURE_UNKNOWN)))
    )
    return failures.withColumn("message", message)


def is_busy() -> Column:
    return ~F.col("stage").isin(*TERMINAL_STAGES) | F.coalesce("has_live_work", F.lit(False))


def busy_count(latest: DataFrame, reserved: int = 0) -> DataFrame:
    """One row: jobs not finished or with live work, plus reserved uploads."""
    return latest.agg((F.count_if(is_busy()) + reserved).alias("busy"))


def expired(jobs: DataFrame, stored: DataFrame, now: Column, hours: int = DEFAULT_RETENTION_HOURS):
    """Ids of finished jobs and stored folders older than the retention.

    ``jobs`` (job_id, stage, has_live_work, modified) is the registry, where a missing time
    counts as old; ``stored`` (job_id, modified) lists folders. A busy job is never expired.
    """
    kept_hours = max(MIN_RETENTION_HOURS, min(MAX_RETENTION_HOURS, hours))
    cutoff = now - F.make_interval(hours=F.lit(kept_hours))
    busy = jobs.filter(is_busy()).select("job_id")
    old = lambda df: df.filter(F.col("modified").isNull() | (F.col("modified") < cutoff))
    from_registry = old(jobs.filter(~is_busy())).select("job_id")
    from_store = stored.filter(F.col("modified") < cutoff).select("job_id").join(
        busy, "job_id", "left_anti"
    )
    return from_registry.unionByName(from_store).distinct()


def latest_vocals(files: DataFrame) -> DataFrame:
    """Newest vocal file of each job."""
    return files.groupBy("job_id").agg(
        F.max_by("path", F.struct("modified", "path")).alias("vocal_path")
    )


def log_tail(log: DataFrame, lines: int = LOG_TAIL_LINES) -> DataFrame:
    """Last non-blank lines of each job without colour codes.

    The rank limit is applied before the shuffle, so a job with a huge log sends at most
    ``lines`` rows per input partition.
    """
    clean = log.withColumn("line", strip_space(strip_ansi(F.col("line")))).filter(F.col("line") != "")
    ranked = clean.withColumn(
        "_rank", F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("seq")))
    )
    return ranked.filter(F.col("_rank") <= lines).drop("_rank")


def pass_progress(log: DataFrame, passes: str = "passes", lines_per_block: int = 4096) -> DataFrame:
    """Progress of a separation run with several passes from the percentages in its log.

    A fall from 75 % or more to 25 % or less starts the next pass.
    """
    found = F.regexp_extract(strip_space(F.col("line")), r"(?<![0-9])([0-9]{1,3})%", 1)
    read = log.withColumn("percent", F.when(found != "", F.least(F.lit(100), found.cast("int"))))
    lines = with_block(read.filter(F.col("percent").isNotNull()), F.col("seq"), lines_per_block)
    counted = counted_steps(
        lines, ["job_id"], ["seq"], "percent", lambda before, now: (before >= 75) & (now <= 25), "_restarts")
    current = F.least(F.col("_restarts"), F.col(passes) - 1)
    share = (current * 100 + F.col("percent")) / (F.col(passes) * 100)
    return counted.select(
        *log.columns, "percent", (current + 1).alias("pass_no"),
        F.least(F.lit(55.0), 8.0 + share * 47.0).alias("progress"),
    )
