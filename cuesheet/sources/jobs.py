"""Stored jobs: result folders, upload manifests, progress snapshots and number series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuesheet.constants import AUDIO_EXTENSIONS, MODEL_FIELDS
from cuesheet.functions.text import base_name, extension
from cuesheet.operators.cleaning import with_defaults
from cuesheet.operators.lines import words_to_lines
from cuesheet.operators.jobs import canonical_language, canonical_profile, latest_vocals

#: A folder, or a file of its own, is called after the job.
JOB_ID = r"(?:^|[/=])([0-9a-f]{32})(?:/|\.[^/.]+$)"
UNIT = "struct<start:double,end:double,fill:double,pause_before:boolean>"
WORDS = f"array<struct<text:string,start:double,end:double,kind:string,phrase:int,timing:array<{UNIT}>>>"
RESULT_SCHEMA = (
    f"ok boolean, words {WORDS}, error string, " + ", ".join(f"{c} string" for c in MODEL_FIELDS)
)
METADATA_SCHEMA = (
    "schema int, filename string, language string, quality string, duration double, "
    "device string, created_at string"
)
PROGRESS_SCHEMA = (
    "stage string, progress double, status string, error string, "
    + ", ".join(f"{c} string" for c in MODEL_FIELDS)
)


def job_id_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, JOB_ID, 1), F.lit(""))


def read_documents(spark: SparkSession, paths, schema: str, recursive: bool = False) -> DataFrame:
    """JSON documents with their job id and modification time; broken ones are left out."""
    read = (
        spark.read.schema(f"{schema}, _broken string")
        .option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", recursive)
        .option("columnNameOfCorruptRecord", "_broken")
        .json(paths)
    )
    return (
        read.select("*", F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_modification_time").alias("modified"))
        .filter(F.col("_broken").isNull())
        .withColumn("job_id", job_id_of(F.col("path")))
        .filter(F.col("job_id").isNotNull())
        .drop("_broken")
    )


def read_metadata(spark: SparkSession, paths, recursive: bool = False) -> DataFrame:
    """Metadata documents of jobs. A listed file that cannot be read has ``broken`` set: unlike a job
    without such a file, its job must not be restored from defaults. Spark lists no files of zero bytes, so
    an empty file counts as absent."""
    listed = scan_manifest(spark, paths, recursive).select(job_id_of(F.col("path")).alias("job_id")).filter("job_id is not null").distinct()
    documents = read_documents(spark, paths, METADATA_SCHEMA, recursive).withColumn("_read", F.lit(True))
    return listed.join(documents, "job_id", "left").withColumn("broken", F.col("_read").isNull()).drop("_read")


def scan_manifest(spark: SparkSession, paths, recursive: bool = False) -> DataFrame:
    """Name, extension, size and time of files. Only these columns are selected, so the
    file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths)
    return files.select(
        "path", base_name(F.col("path")).alias("file_name"),
        extension(F.col("path")).alias("extension"), F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    )


def restore_jobs(
    results: DataFrame, metadata: DataFrame, sources: DataFrame, vocals: DataFrame | None = None
) -> DataFrame:
    """Completed jobs that can be shown again.

    A job needs an ok result with words and a source file of an audio type, and metadata that is
    not broken; without metadata it takes the defaults. Missing or
    unknown profile and language fall back to accurate and english; a missing model id falls
    back to the model's name.
    """
    good = results.filter(F.col("ok") & (F.size("words") > 0))
    audio = sources.filter(F.col("extension").isin(*AUDIO_EXTENSIONS)).groupBy("job_id").agg(
        F.min("file_name").alias("source_name")
    )
    about = metadata.select(
        "job_id", "filename", "language", "quality", "duration", "device", "created_at",
        F.col("broken") if "broken" in metadata.columns else F.lit(False).alias("broken"),
    )
    joined = good.join(audio, "job_id").join(about, "job_id", "left").filter(~F.coalesce("broken", F.lit(False)))
    named = canonical_profile(
        canonical_language(joined.withColumn("quality", F.coalesce("quality", F.lit("accurate"))))
    )
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    model_id = lambda c: F.coalesce(
        F.nullif(F.col(f"{c}_id"), F.lit("")), F.nullif(F.col(c), F.lit("")), F.lit("")
    )
    restored = named.select(
        "job_id", F.coalesce("filename", "source_name").alias("filename"),
        F.coalesce("profile", F.lit("accurate")).alias("quality"),
        F.coalesce("canonical_language", F.lit("english")).alias("language"), "duration",
        F.coalesce(F.to_timestamp(F.col("created_at")), "modified").alias("created_at"),
        F.lit("complete").alias("stage"), F.lit(100.0).alias("progress"),
        F.concat(F.size("words").cast("string"), F.lit(" words synced locally")).alias("status"),
        F.coalesce("device", F.lit("Local GPU")).alias("device"), "words",
        text("transcription_backend").alias("transcription_backend"),
        text("transcription_model").alias("transcription_model"),
        model_id("transcription_model").alias("transcription_model_id"),
        text("alignment_model").alias("alignment_model"),
        model_id("alignment_model").alias("alignment_model_id"),
    )
    if vocals is None:
        return restored.withColumn("vocal_path", F.lit(None).cast("string"))
    return restored.join(latest_vocals(vocals), "job_id", "left")


def restored_lines(restored: DataFrame) -> DataFrame:
    """(job_id, line_no, line_id, start, end, kind, words): lines of restored jobs, grouped anew from their words."""
    words = restored.select(F.col("job_id").alias("track_id"), F.posexplode("words").alias("word_no", "word")).select(
        "track_id", F.col("word_no").cast("long").alias("word_no"), "word.text", "word.start", "word.end", "word.kind", "word.phrase")
    return words_to_lines(with_defaults(words)).withColumnRenamed("track_id", "job_id")


def read_job_results(spark: SparkSession, root: str) -> DataFrame:
    """Restore from one folder per job: job.json, inference-result.json, source.*, separated/."""
    with_id = lambda df: df.withColumn("job_id", job_id_of(F.col("path"))).filter(
        F.col("job_id").isNotNull()
    )
    files = with_id(scan_manifest(spark, root, recursive=True))
    return restore_jobs(
        read_documents(spark, f"{root}/*/inference-result.json", RESULT_SCHEMA),
        read_metadata(spark, f"{root}/*/job.json"),
        files.filter(F.col("file_name").startswith("source.")),
        files.filter((F.col("file_name") == "vocals.wav") & F.contains(F.col("path"), F.lit("/separated/"))),
    )


def read_progress_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Progress snapshots as they appear; unreadable ones are skipped."""
    stream = (
        spark.readStream.schema(f"job_id string, ts timestamp, {PROGRESS_SCHEMA}, _broken string")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )
    return stream.filter(F.col("_broken").isNull()).drop("_broken")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample series (track_id, idx, v); decoding audio is done elsewhere."""
    return spark.read.schema("track_id bigint, idx bigint, v float").parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("track_id bigint, frame_no bigint, rms double").parquet(path)


def read_emissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "segment_id bigint, frame bigint, token_id bigint, logp double"
    ).parquet(path)
