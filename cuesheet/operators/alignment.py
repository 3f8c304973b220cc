"""Roll-ups of token spans and model scores to timed words, and the choice between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cuesheet.constants import (
    ALIGNER_LANGUAGES, AUTO_NAMES, ENGLISH_NAMES, MAX_WORD_SECONDS, MIN_ALIGNMENT_CONFIDENCE,
    MIN_ALIGNMENT_COVERAGE, MIN_SIDE_ALIGNMENT_CONFIDENCE, SAMPLE_RATE,
)
from cuesheet.functions.numeric import round_exact
from cuesheet.functions.text import ascii_letters_only, is_hallucination, normalize_for_concat, strip_space
from cuesheet.plans.session import constant_table


def refined_spans(spans: DataFrame, emissions: DataFrame, blank_id: int) -> DataFrame:
    """Narrow each token span to the frames where the token is at least as likely as blank.

    Without such a frame the first frame of the highest score stands. ``best`` is the highest
    score inside the original span. Scores meet spans on (segment, token) and blanks on
    (segment, frame); both sides stay rows, so a long segment spreads over tasks.
    """
    scores = spans.join(emissions, ["segment_id", "token_id"]).filter(
        (F.col("frame") >= F.col("f0")) & (F.col("frame") < F.col("f1"))
    )
    blanks = emissions.filter(F.col("token_id") == blank_id).select(
        "segment_id", "frame", F.col("logp").alias("blank")
    )
    active = F.col("logp") >= F.col("blank")
    grouped = scores.join(blanks, ["segment_id", "frame"]).groupBy("segment_id", "token_no").agg(
        F.first("owner_word").alias("owner_word"),
        F.min(F.when(active, F.col("frame"))).alias("_first"),
        F.max(F.when(active, F.col("frame"))).alias("_last"),
        F.max_by("frame", F.struct("logp", -F.col("frame"))).alias("_peak"),
        F.max("logp").alias("best"),
    )
    return grouped.select(
        "segment_id", "token_no", "owner_word",
        F.coalesce("_first", "_peak").alias("start_frame"),
        (F.coalesce("_last", "_peak") + 1).alias("end_frame"), "best",
    )


def word_roll_up(refined: DataFrame, frame_seconds: Column) -> DataFrame:
    """Words from their tokens: times and exp(mean of the tokens' best scores)."""
    owned = refined.filter(F.col("owner_word").isNotNull()).withColumn("_fs", frame_seconds)
    grouped = owned.groupBy("segment_id", "owner_word").agg(
        (F.min_by("start_frame", "token_no") * F.first("_fs")).alias("_start"),
        (F.max_by("end_frame", "token_no") * F.first("_fs")).alias("_end"),
        F.exp(F.avg("best")).alias("_confidence"), F.count(F.lit(1)).alias("n_tokens"),
    )
    return grouped.select(
        "segment_id", "owner_word", round_exact(F.col("_start")).alias("start"),
        round_exact(F.col("_end")).alias("end"),
        round_exact(F.col("_confidence"), 4).alias("confidence"), "n_tokens",
    )


def timing_units(refined: DataFrame, frame_seconds: Column) -> DataFrame:
    """One unit per token of a word: times, fill reached, and the gap before it.

    The window is one word's letters. ``gap_start``/``gap_end`` feed the silence test whose
    verdict becomes ``pause_before``.
    """
    word = W.partitionBy("segment_id", "owner_word")
    ordered = word.orderBy("token_no")
    owned = refined.filter(F.col("owner_word").isNotNull()).withColumn("_fs", frame_seconds)
    placed = owned.select(
        "segment_id", "owner_word", "token_no",
        (F.row_number().over(ordered)).alias("unit_no"), F.count(F.lit(1)).over(word).alias("_n"),
        (F.lag("end_frame").over(ordered) * F.col("_fs")).alias("gap_start"),
        (F.col("start_frame") * F.col("_fs")).alias("_start"),
        (F.greatest(F.col("start_frame") + 1, F.col("end_frame")) * F.col("_fs")).alias("_end"),
        (F.first("start_frame").over(ordered) * F.col("_fs")).alias("word_start"),
        (F.max_by("end_frame", "token_no").over(word) * F.col("_fs")).alias("word_end"),
    ).withColumn("_fill", F.col("unit_no") / F.col("_n"))
    return placed.select(
        "segment_id", "owner_word", "unit_no",
        round_exact(F.col("_start")).alias("start"), round_exact(F.col("_end")).alias("end"),
        round_exact(F.col("_fill"), 4).alias("fill"), "gap_start",
        F.when(F.col("gap_start").isNotNull(), F.col("_start")).alias("gap_end"),
        "word_start", "word_end",
    )


def units_to_timing(units: DataFrame, silent: DataFrame) -> DataFrame:
    """Units with the verdicts of their gaps, collected per word."""
    unit = F.struct(
        "unit_no", "start", "end", "fill",
        F.coalesce("silent", F.lit(False)).alias("pause_before"),
    )
    joined = units.join(silent, ["segment_id", "owner_word", "unit_no"], "left")
    return joined.groupBy("segment_id", "owner_word").agg(
        F.transform(
            F.array_sort(F.collect_list(unit)), lambda u: u.dropFields("unit_no")
        ).alias("timing")
    )


def segment_scores(aligned: DataFrame, raw: DataFrame) -> DataFrame:
    """Confidence weighted by spoken length, and the share of the spoken length covered.

    Both inputs have (segment_id, spoken_length); aligned words also have a confidence.
    """
    weight = F.greatest(F.lit(1), F.col("spoken_length"))
    expected = raw.filter(F.col("spoken_length") > 0).groupBy("segment_id").agg(
        F.sum(weight).alias("expected")
    )
    covered = aligned.groupBy("segment_id").agg(
        F.sum(weight).alias("covered"),
        (F.sum(weight * F.col("confidence")) / F.sum(weight)).alias("confidence"),
    )
    return raw.select("segment_id").distinct().join(covered, "segment_id", "left").join(
        expected, "segment_id", "left"
    ).select(
        "segment_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(
            F.col("expected") > 0,
            F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.col("expected")),
        ).otherwise(0.0).alias("coverage"),
    )


def uses_english(requested: Column, detected: Column) -> Column:
    asked = ascii_letters_only(strip_space(F.coalesce(requested, F.lit(""))))
    found = ascii_letters_only(strip_space(F.coalesce(detected, F.lit(""))))
    return asked.isin(*ENGLISH_NAMES) | (asked.isin(*AUTO_NAMES) & found.isin(*ENGLISH_NAMES))


def aligner_language(spark, segments: DataFrame) -> DataFrame:
    """Adds ``aligner_language``, null when the multilingual aligner does not know it."""
    names = [(a, name) for name, spellings in ALIGNER_LANGUAGES.items() for a in spellings]
    dim = constant_table(spark, names, "_key string, aligner_language string")
    compact = lambda c: F.replace(
        F.lower(strip_space(F.coalesce(F.col(c), F.lit("")))), F.lit("-"), F.lit("")
    )
    asked = compact("requested_language")
    key = F.when(asked.isin(*AUTO_NAMES), compact("detected_language")).otherwise(asked)
    return segments.withColumn("_key", key).join(dim, "_key", "left").drop("_key")


def acceptance(confidence: Column, coverage: Column, layer: Column, text: Column) -> Column:
    """aligned, raw or drop for a segment that has a token path."""
    side = layer == "side"
    least = F.when(side, MIN_SIDE_ALIGNMENT_CONFIDENCE).otherwise(MIN_ALIGNMENT_CONFIDENCE)
    invented = is_hallucination(text)
    good = (confidence >= least) & (coverage >= MIN_ALIGNMENT_COVERAGE) & ~invented
    return F.when(good, "aligned").when(invented | side, "drop").otherwise("raw")


def route_alignment(segments: DataFrame) -> DataFrame:
    """Where each segment's words come from, and the confidence they carry.

    Needs backend, requested_language, detected_language, aligner_language, source_layer,
    multilingual_ok, has_path, confidence, coverage and aligned_text. ``path_error``, if there, tells that the
    token alignment itself failed: raw words stay without confidence then, also in side segments.
    """
    english = uses_english(F.col("requested_language"), F.col("detected_language"))
    multilingual = (F.col("backend") == "qwen3") & F.col("aligner_language").isNotNull()
    needed = multilingual | ((F.col("backend") != "none") & english)
    side = F.col("source_layer") == "side"
    accepted = acceptance(
        F.col("confidence"), F.col("coverage"), F.col("source_layer"), F.col("aligned_text")
    )
    failed_multilingual = F.col("backend") == "qwen3"
    broken = F.coalesce(F.col("path_error"), F.lit(False)) if "path_error" in segments.columns else F.lit(False)
    route = (
        F.when(~needed, "raw")
        .when(multilingual & F.col("multilingual_ok"), "multilingual")
        .when(failed_multilingual & side, "drop")
        .when(failed_multilingual & ~english, "raw")
        .when(broken, "raw")
        .when(~F.col("has_path") & side, "drop")
        .when(~F.col("has_path"), "raw")
        .otherwise(accepted)
    )
    scored = (
        F.when(~needed, 1.0)
        .when(multilingual & F.col("multilingual_ok"), 1.0)
        .when(failed_multilingual & (side | ~english), 0.0)
        .when(broken | ~F.col("has_path"), 0.0)
        .otherwise(F.col("confidence"))
    )
    return segments.withColumn("route", route).withColumn("segment_confidence", scored)


def routed_words(routes: DataFrame, raw: DataFrame, aligned: DataFrame, multilingual: DataFrame):
    """Words of the chosen branch of every segment; dropped segments have none."""
    branches = {"raw": raw, "aligned": aligned, "multilingual": multilingual}
    parts = [
        words.join(
            routes.filter(F.col("route") == route).select("segment_id", "segment_confidence"),
            "segment_id",
        )
        for route, words in branches.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def segment_bounds(chunks: DataFrame, sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """Clamp a recognised chunk to its audio and derive the crop around it."""
    seconds = F.col("chunk_seconds")
    start = F.greatest(F.lit(0.0), F.least(seconds, F.coalesce("chunk_start", F.lit(0.0))))
    bounded = chunks.withColumn("segment_start", start).withColumn(
        "segment_end",
        F.greatest(F.col("segment_start") + 0.04, F.least(seconds, F.coalesce("chunk_end", seconds))),
    )
    cropped = bounded.withColumn(
        "crop_start", F.greatest(F.lit(0.0), F.col("segment_start") - 0.3)
    ).withColumn("crop_end", F.least(seconds, F.col("segment_end") + 0.3))
    return cropped.withColumn(
        "first_sample", (F.col("crop_start") * sample_rate).cast("long")
    ).withColumn(
        "last_sample",
        F.greatest(F.col("first_sample") + 1, (F.col("crop_end") * sample_rate).cast("long")),
    ).withColumn("local_start", F.col("segment_start") - F.col("crop_start")).withColumn(
        "spoken_seconds", F.greatest(F.lit(0.04), F.col("segment_end") - F.col("segment_start"))
    )


def place_words(words: DataFrame) -> DataFrame:
    """Local word times (and their units) to track time; words above 4 s are dropped.

    ``segment_time`` is the segment's own start. Rounded to ms, at least 0.04 s long; units
    at least 0.008 s.
    """
    base = F.col("segment_time")
    placed = words.withColumn("_s", base + F.col("start")).withColumn("_e", base + F.col("end"))
    kept = placed.filter(F.col("_e") - F.col("_s") <= MAX_WORD_SECONDS)
    bounded = kept.withColumn("_s0", F.greatest(F.lit(0.0), F.col("_s"))).withColumn(
        "_e0", F.greatest(F.col("_s") + 0.04, F.col("_e"))
    )
    unit = lambda u: F.struct(
        round_exact(F.greatest(F.lit(0.0), base + u["start"])).alias("start"),
        round_exact(F.greatest(base + u["start"] + 0.008, base + u["end"])).alias("end"),
        round_exact(u["fill"], 4).alias("fill"),
        F.coalesce(u["pause_before"], F.lit(False)).alias("pause_before"),
    )
    return bounded.select(
        *[c for c in words.columns if c not in ("start", "end", "timing", "segment_time")],
        round_exact(F.col("_s0")).alias("start"), round_exact(F.col("_e0")).alias("end"),
        F.transform("timing", unit).alias("timing"),
    )


def map_timestamps(raw: DataFrame, items: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Aligner items to words: display text by position when the counts agree.

    Otherwise the item text stands with the phrase's first word as template, unless the two
    normalised texts do not contain one another, which rejects the phrase.
    ``raw``: (track_id, phrase, pos, text, kind); ``items``: (track_id, phrase, pos, text,
    start_time, end_time). Positions count from 0 on both sides.
    """
    keys = ["track_id", "phrase"]
    joined_text = lambda name: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda w: w["text"]), ""
    ).alias(name)
    phrases = raw.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n_raw"), F.min_by("kind", "pos").alias("_first_kind"),
        joined_text("_raw_text"),
    )
    counted = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_items"))
    times = (
        items.withColumn("start", F.coalesce("start_time", F.lit(0.0)))
        .withColumn("end", F.coalesce("end_time", "start"))
        .filter(F.col("end") > F.col("start"))
    )
    shown = raw.select(*keys, "pos", F.col("text").alias("_shown"), F.col("kind").alias("_kind"))
    exact = F.col("_n_raw") == F.col("_n_items")
    mapped = (
        times.join(phrases.join(counted, keys), keys)
        .join(shown, [*keys, "pos"], "left")
        .select(
            *keys, "pos",
            strip_space(F.when(exact, F.col("_shown")).otherwise(F.col("text"))).alias("text"),
            "start", "end",
            F.when(exact, F.col("_kind")).otherwise(F.col("_first_kind")).alias("kind"),
            F.lit(1.0).alias("confidence"), exact.alias("_exact"), "_raw_text",
        )
        .filter(F.col("text") != "")
    )
    unequal = mapped.filter(~F.col("_exact")).groupBy(*keys).agg(
        F.first("_raw_text").alias("_raw_text"), joined_text("_item_text")
    )
    source = normalize_for_concat(F.col("_raw_text"), ascii_only)
    spoken = normalize_for_concat(F.col("_item_text"), ascii_only)
    rejected = unequal.withColumn("_a", source).withColumn("_b", spoken).filter(
        (F.col("_a") != "") & (F.col("_b") != "")
        & ~F.contains(F.col("_a"), F.col("_b")) & ~F.contains(F.col("_b"), F.col("_a"))
    )
    return mapped.join(rejected.select(*keys), keys, "left_anti").drop("_exact", "_raw_text")
