"""Timed-text tables derived from the driver's parquet tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cuesheet.functions.numeric import round_exact
from cuesheet.functions.text import pieces
from cuesheet.operators.phrases import proportional_timings

PHRASE_SECONDS = 30.0
PIECE_SECONDS = 0.35


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(tracks: DataFrame) -> DataFrame:
    """Few and small rows of which each becomes many: adaptive execution would join them in one task, by their size before.

    By a hash of its own, as Spark drops a repartition that the grouping before it already satisfies."""
    return tracks.repartition(int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("track_id"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as phrases: 30 s apart, 0.35 s per piece."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").alias("track_id"),
        F.col("turn").cast("int").alias("phrase"),
        F.when(F.col("role") == "assistant", "adlib").otherwise("lead").alias("kind"),
        "text",
        (F.col("turn") * PHRASE_SECONDS).alias("phrase_start"),
        pieces(F.col("text")).alias("piece_list"),
    ).withColumn("phrase_seconds", F.size("piece_list") * PIECE_SECONDS)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public words of all conversations (track, phrase, kind, proportional times)."""
    exploded = phrases(spark, sf_dir).select(
        "track_id", "phrase", "kind", "phrase_start", "phrase_seconds",
        F.posexplode("piece_list").alias("pos", "text"),
    )
    timed = proportional_timings(
        exploded, ["track_id", "phrase"], "pos", "text",
        F.col("phrase_start"), F.col("phrase_seconds"),
    )
    return timed.select(
        "track_id",
        (F.shiftleft(F.col("phrase").cast("long"), 32) + F.col("pos")).alias("word_no"),
        "text", "start", "end", "kind", "phrase",
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals: seconds since 2024-01-01, ``value`` minutes long."""
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"), F.col("event_id").alias("interval_id"), "event_type",
        start.alias("start"), (start + F.col("value") * 60.0).alias("end"),
    )


def probes(intervals_table: DataFrame) -> DataFrame:
    """Probe times of each track: every six hours from its first interval, 30 days long."""
    first = intervals_table.groupBy("track_id").agg(F.min("start").alias("first"))
    return dealt(first).select(
        "track_id",
        F.explode(
            F.transform(F.sequence(F.lit(0), F.lit(119)), lambda k: F.col("first") + k * 21600.0)
        ).alias("t"),
    )


def event_lines(intervals_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events as words of one line per (track, day): word and line tables with indexes."""
    from cuesheet.operators.intervals import indexed

    words = intervals_table.select(
        "track_id", "interval_id", "start", "end",
        F.when(F.col("event_type").isin("error", "signup"), "adlib").otherwise("lead").alias("kind"),
        F.floor(F.col("start") / 86400.0).cast("long").alias("line_no"),
    )
    order = F.struct("start", "end", "interval_id")
    lines = words.groupBy("track_id", "line_no").agg(
        (F.min("start") - 0.03).alias("start"),
        (F.max_by("end", order) + 0.24).alias("end"),
        F.min_by("kind", order).alias("kind"),
    )
    return (
        indexed(words, "interval_id", block_seconds=86400.0 * 30),
        indexed(lines, "line_no", block_seconds=86400.0 * 365),
    )


def hours(events: DataFrame) -> DataFrame:
    """Frames 0..719 of every track."""
    tracks = dealt(events.select("track_id").distinct())
    return tracks.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(719).cast("long"))).alias("frame_no"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event energy of each user as frames 0..719; hours without events are silent."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"),
        F.floor(start / 3600000000).cast("long").alias("frame_no"), "value",
    )
    # One silent row per hour joins the sums, so no grid join is needed.
    padded = events.unionByName(hours(events).withColumn("value", F.lit(None).cast("double")))
    return padded.groupBy("track_id", "frame_no").agg(
        F.coalesce(F.sqrt(F.sum(F.col("value") * F.col("value")) / F.count("value")), F.lit(0.0))
        .alias("rms")
    )


HOP = 800  # samples per frame at 16 kHz


def frame_sizes(frames_table: DataFrame) -> DataFrame:
    return frames_table.groupBy("track_id").agg(
        (F.count(F.lit(1)) * HOP).alias("n_samples")
    )


VECTORS_PER_TRACK = 16
VECTOR_SIZE = 64
SAMPLE_RATE = 1000  # of the sample fixture


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as sample series: 16 vectors of 64 values per track, 1 kHz.

    On even tracks the middle of the series is damped, so that it holds a silent gap.
    """
    flat = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / VECTORS_PER_TRACK).cast("long").alias("track_id"),
        F.col("vec_id"), F.posexplode("embedding").alias("pos", "v"),
    )
    idx = (F.col("vec_id") % VECTORS_PER_TRACK) * VECTOR_SIZE + F.col("pos")
    damped = (F.col("track_id") % 2 == 0) & idx.between(300, 700)
    return flat.select(
        "track_id", idx.cast("long").alias("idx"),
        (F.col("v").cast("double") * F.when(damped, 0.01).otherwise(1.0)).alias("v"),
    )


def sample_sizes(samples_table: DataFrame) -> DataFrame:
    return samples_table.groupBy("track_id").agg((F.max("idx") + 1).alias("n_samples"))


def gaps(sizes: DataFrame) -> DataFrame:
    """Three gaps per track, at places and lengths that depend on the track."""
    return sizes.select("track_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("gap_no")).select(
        "track_id", F.col("gap_no").cast("long").alias("gap_no"),
        (F.lit(0.1) + F.col("gap_no") * 0.1 + (F.col("track_id") % 5) * 0.05).alias("gap_start"),
        (F.lit(0.3) + F.col("gap_no") * 0.2 + (F.col("track_id") % 4) * 0.1).alias("gap_end"),
        F.lit(0.05).alias("word_start"), F.lit(0.98).alias("word_end"),
    )


CANDIDATE_RULES = (("first", 7, 11, 13), ("second", 5, 9, 17))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a timed reference transcript."""
    tokens = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("track_id"), pieces(F.col("text")).alias("p")
    ).select(
        "track_id", F.size("p").alias("n"), F.posexplode("p").alias("pos", "text")
    )
    timed = proportional_timings(
        tokens, ["track_id"], "pos", "text", F.lit(0.0), F.col("n") * PIECE_SECONDS
    )
    return timed.select(
        "track_id", F.col("pos").cast("long").alias("pos"), "text", "start", "end",
        F.lit("lead").alias("kind"),
    )


def candidates(references_table: DataFrame) -> DataFrame:
    """Two damaged copies per reference: words dropped, replaced, inserted, and shifted."""
    window = Window.partitionBy("track_id").orderBy("pos")
    rules = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.lit(d).alias("d"), F.lit(r).alias("r"), F.lit(i).alias("i"))
            for label, d, r, i in CANDIDATE_RULES
        ]
    )
    n = F.col("pos") + 1
    shift = (F.col("pos") + 40) / 1000.0
    base = references_table.withColumn("next", F.lead("text", 1, "end").over(window)).withColumn(
        "rule", F.explode(rules)
    )
    kept = F.when(
        n % F.col("rule.d") != 0,
        F.struct(
            (F.col("pos") * 2).alias("pos"),
            F.when(n % F.col("rule.r") == 0, F.col("next")).otherwise(F.col("text")).alias("text"),
        ),
    )
    filler = F.when(
        n % F.col("rule.i") == 0,
        F.struct((F.col("pos") * 2 + 1).alias("pos"), F.lit("filler").alias("text")),
    )
    return base.select(
        "track_id", F.col("rule.label").alias("label"),
        F.explode(F.array_compact(F.array(kept, filler))).alias("w"),
        (F.col("start") + shift).alias("start"), (F.col("end") + shift * 1.5).alias("end"), "kind",
    ).select("track_id", "label", "w.pos", "w.text", "start", "end", "kind")


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as short words: an hour becomes 0.1 s, the event type is the text."""
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3.6e9
    types = F.array_position(
        F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")]),
        F.col("event_type"),
    )
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"), F.col("event_id").alias("word_no"),
        F.col("event_type").alias("text"), (hours * 0.1).alias("_s"), "value", types.alias("_type"),
    )
    timed = raw.withColumn("start", round_exact(F.col("_s"))).withColumn(
        "_e", F.col("start") + 0.04 + F.col("value") * 0.01
    ).withColumn("end", round_exact(F.col("_e")))
    phrase = (F.floor(F.col("start") / 2.4) * 5 + F.col("_type")).cast("int")
    return timed.select(
        "track_id", "word_no", "text", "start", "end",
        F.when(F.col("word_no") % 4 == 0, "adlib").otherwise("lead").alias("kind"),
        F.when(F.col("word_no") % 7 == 0, -1).otherwise(phrase).alias("phrase"),
    )


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as token scores: 8 frames of 8 tokens per segment."""
    flat = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("segment_id"), F.posexplode("embedding").alias("p", "v")
    )
    return flat.select(
        "segment_id", F.floor(F.col("p") / 8).cast("long").alias("frame"),
        (F.col("p") % 8).cast("long").alias("token_id"),
        (-F.abs(F.col("v").cast("double")) * 10).alias("logp"),
    )


def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tokens per segment, two per word; the third is a delimiter without owner."""
    segments = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("segment_id")).distinct()
    t = F.col("token_no")
    return segments.select("segment_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("token_no")).select(
        "segment_id", t.cast("long").alias("token_no"),
        (1 + (t * 3 + F.col("segment_id")) % 7).cast("long").alias("token_id"),
        t.cast("long").alias("f0"), (t + 3).cast("long").alias("f1"),
        F.when(t != 2, F.floor(t / 2)).cast("long").alias("owner_word"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: status as stage, priority as requested profile."""
    key = F.col("o_orderkey")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))
    return table(spark, sf_dir, "orders").select(
        key.alias("job_no"), F.lpad(F.lower(F.hex(key)), 32, "0").alias("job_id"),
        F.concat(
            F.lit("Track_"), F.col("o_custkey").cast("string"),
            pick([" - Artist", "", " - A - B"], key), F.lit("."),
            pick(["mp3", "WAV", "txt", "flac"], key),
        ).alias("filename"),
        F.when(F.col("o_orderstatus") == "F", pick(["complete", "error", "cancelled"], key))
        .when(F.col("o_orderstatus") == "O", "queued").otherwise("transcribing").alias("stage"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "fast")
        .when(F.col("o_orderpriority") == "2-HIGH", " Accurate ")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "balanced")
        .when(F.col("o_orderpriority") == "5-LOW", "turbo").alias("quality"),
        pick(["EN", "Auto-detect", "pt", "klingon", "français", "fre"], key).alias("language"),
        (key % 1300 / 10.0 - 10.0).alias("progress"),
        (F.col("o_totalprice") / 40.0).alias("duration"),
        F.floor(F.col("o_totalprice") * 1200).cast("long").alias("bytes"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        pick(
            ["CUDA out of memory", "cuda: no kernel image is available", "Connection reset",
             "first line\nlast line  ", "", "Download failed"], key
        ).alias("error"),
        F.when(key % 4 != 0, F.concat(F.lit("log "), key.cast("string"))).alias("last_log"),
        F.when(key % 3 == 0, "lab/asr-small").otherwise("").alias("transcription_model_id"),
        F.when(key % 5 == 0, "vocals.wav").alias("vocal_path"),
    )


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as log lines: two lines each, a percentage and a coloured blank or note."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).cast("long").alias("_at"),
        F.col("l_suppkey").alias("_s"), (F.col("l_quantity") * 2).cast("int").alias("_q"),
    )
    note = F.when(F.col("_s") % 3 == 0, "\x1b[0m \x1b[31m").otherwise(
        F.concat(F.lit("\x1b[32mnote "), F.col("_s").cast("string"), F.lit("\x1b[0m"))
    )
    return items.select(
        "job_id", F.posexplode(
            F.array(F.concat(F.lit("separating "), F.col("_q").cast("string"), F.lit("% done")), note)
        ).alias("_k", "line"), "_at", "_s",
    ).select(
        "job_id", (F.col("_at") * 2000 + F.col("_s") * 2 + F.col("_k")).alias("seq"), "line"
    )
