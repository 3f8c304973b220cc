"""Comparing candidate transcripts with a reference: alignment, error rates, timing errors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cuesheet.functions.edit import edit_distance, edit_path
from cuesheet.functions.numeric import round_exact
from cuesheet.functions.text import evaluation_form, strip_space, with_folded
from cuesheet.operators.anchors import PIECE, cut_long_pairs
from cuesheet.plans.percentiles import exact_percentiles
from cuesheet.plans.session import stage

OPERATIONS = ("match", "substitution", "deletion", "insertion")
THRESHOLDS = {"onset_within_50ms": 0.05, "onset_within_100ms": 0.10, "onset_within_250ms": 0.25}
DELTAS = ("onset", "offset", "duration")


def candidate_label(spec: Column) -> Column:
    """Text before the first ``=``, else the file stem; an empty label is an error."""
    named = F.contains(spec, F.lit("="))
    label = strip_space(F.substring_index(spec, "=", 1))
    stem = F.regexp_replace(F.substring_index(spec, "/", -1), r"(?<=.)\.[^.]*$", "")
    return F.when(
        named & (label == ""), F.raise_error(F.lit("Candidate labels cannot be empty.")).cast("string")
    ).when(named, label).otherwise(stem)


def evaluation_tokens(words: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Trimmed text, normal form, and a ``problem`` where times are not usable."""
    text = strip_space(F.coalesce("text", F.lit("")))
    start, end = F.col("start"), F.col("end")
    bad = lambda t: F.isnan(t) | (F.abs(t) == float("inf")) | (t < 0)
    problem = (
        F.when(bad(start), "invalid start").when(bad(end), "invalid end")
        .when(start.isNull() != end.isNull(), "only one timestamp")
        .when(end < start, "ends before it starts")
    )
    folded = with_folded(words.withColumn("text", text), F.col("text"), "normalized", ascii_only)
    tokens = folded.withColumn("normalized", evaluation_form(F.col("normalized")))
    return tokens.filter(F.col("normalized") != "").withColumn("problem", problem)


def validated(tokens: DataFrame, strict: bool = True) -> DataFrame:
    """Strict: the first unusable token stops the job. Otherwise such tokens are left out."""
    if not strict:
        return tokens.filter(F.col("problem").isNull()).drop("problem")
    message = F.concat(F.lit("Word '"), F.col("text"), F.lit("': "), F.col("problem"))
    checked = F.when(
        F.col("problem").isNotNull(), F.raise_error(message).cast("string")
    ).otherwise(F.col("normalized"))
    return tokens.withColumn("normalized", checked).drop("problem")


def without_adlibs(tokens: DataFrame, include_adlibs: bool = False) -> DataFrame:
    return tokens if include_adlibs else tokens.filter(~F.col("kind").eqNullSafe("adlib"))


_STEP = T.StructType([T.StructField(n, T.IntegerType()) for n in ("op", "ref", "cand")])


@F.pandas_udf(T.ArrayType(_STEP))
def _edit_steps(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    def steps(ref, cand):
        return [
            {"op": int(o), "ref": int(r), "cand": int(c)} for o, r, c in zip(*edit_path(ref, cand))
        ]

    return pd.Series([steps(r, c) for r, c in zip(reference, candidate)])


def _sequences(tokens: DataFrame, keys: list[str], name: str) -> DataFrame:
    token = F.struct("pos", "text", "normalized", "start", "end", "kind")
    return tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(token)).alias(name))


def sequence_pairs(reference: DataFrame, candidates: DataFrame, pairs: DataFrame | None = None):
    """One row per (track, label) with both token sequences.

    ``pairs`` names the comparisons that must exist even where a candidate has no token.
    A sequence is one track's words; pairs, not tracks, are the unit of work, so the rows are
    spread by (track, label) before the alignment.
    """
    cand = _sequences(candidates, ["track_id", "label"], "cand")
    if pairs is not None:
        cand = pairs.select("track_id", "label").distinct().join(cand, ["track_id", "label"], "left")
    joined = cand.join(_sequences(reference, ["track_id"], "ref"), "track_id", "left")
    empty = joined.withColumn(
        "cand", F.coalesce("cand", F.array().cast(joined.schema["cand"].dataType))
    )
    if_missing = F.raise_error(F.lit("The reference contains no evaluable words."))
    return empty.withColumn(
        "ref", F.coalesce("ref", if_missing.cast(joined.schema["ref"].dataType))
    ).repartition("track_id", "label")


def aligned_pairs(pairs: DataFrame) -> DataFrame:
    """Adds ``steps``: array of (operation, ref token, cand token) in order."""
    normal = lambda column: F.transform(column, lambda t: t["normalized"])
    names = F.array(*[F.lit(o) for o in OPERATIONS])
    return pairs.withColumn("_path", _edit_steps(normal("ref"), normal("cand"))).withColumn(
        "steps",
        F.transform(
            "_path",
            lambda s: F.struct(
                F.get(names, s["op"]).alias("operation"),
                F.when(s["ref"] >= 0, F.get(F.col("ref"), s["ref"])).alias("ref"),
                F.when(s["cand"] >= 0, F.get(F.col("cand"), s["cand"])).alias("cand"),
            ),
        ),
    ).drop("_path")


def pair_sizes(reference: DataFrame, candidates: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(track_id, label, n, m): tokens of both sides of each comparison."""
    m = candidates.groupBy("track_id", "label").agg(F.count(F.lit(1)).alias("m"))
    if pairs is not None:
        m = pairs.select("track_id", "label").distinct().join(m, ["track_id", "label"], "left")
    n = reference.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    return m.join(n, "track_id", "left").select("track_id", "label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))


def _steps_of_pieces(reference: DataFrame, candidates: DataFrame, sizes: DataFrame, piece: int) -> DataFrame:
    """(track_id, label, step_no, operation, ref, cand) of long pairs: their pieces are aligned in tasks of their own."""
    pair = ["track_id", "label"]
    cut = cut_long_pairs(reference, candidates, sizes, piece).repartition(*pair, "number")
    found = stage(aligned_pairs(cut).select(*pair, "number", "steps"), "pieces")
    # one row for a piece
    lengths = found.select(*pair, "number", F.size("steps").alias("steps"))
    first = lengths.select(*pair, "number", F.expr(
        "coalesce(sum(steps) over (partition by track_id, label order by number rows between unbounded preceding and 1 preceding), 0)").alias("_first"))
    each = found.join(first, [*pair, "number"]).select(*pair, "_first", F.posexplode("steps").alias("at", "step"))
    return each.select(*pair, (F.col("_first") + F.col("at")).cast("int").alias("step_no"), "step.operation", "step.ref", "step.cand")


def _split_pairs(reference: DataFrame, candidates: DataFrame, pairs: DataFrame | None, piece: int):
    """Sizes of the pairs that are aligned in pieces, or None; and what selects the others."""
    long = stage(pair_sizes(reference, candidates, pairs).filter((F.col("n") >= 2 * piece) & (F.col("m") >= 2 * piece)), "long")
    return None if long.isEmpty() else long


def _short(candidates: DataFrame, pairs: DataFrame | None, long: DataFrame | None):
    if long is None:
        return candidates, pairs
    keys = long.select("track_id", "label")
    others = lambda df: df.join(keys, ["track_id", "label"], "left_anti")
    return others(candidates), None if pairs is None else others(pairs)


def align(reference: DataFrame, candidates: DataFrame, pairs: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """One row per alignment step. Pairs with ``piece`` tokens twice over on both sides are cut where
    every cheapest path passes, so their pieces are tasks of their own."""
    long = _split_pairs(reference, candidates, pairs, piece)
    few, named = _short(candidates, pairs, long)
    steps = aligned_pairs(sequence_pairs(reference, few, named)).select(
        "track_id", "label", F.posexplode("steps").alias("step_no", "step")
    ).select("track_id", "label", "step_no", "step.operation", "step.ref", "step.cand")
    if long is not None:
        steps = steps.unionByName(_steps_of_pieces(reference, candidates, long, piece))
    return steps.select(
        "track_id", "label", "step_no", "operation",
        F.col("ref.pos").alias("ref_pos"), F.col("cand.pos").alias("cand_pos"), "ref", "cand",
    )


#: Cells of a table of characters beyond which the bit-wise distance takes over.
CELLS = 16_000_000


@F.pandas_udf(T.IntegerType())
def _long_distance(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else edit_distance(r, c) for r, c in zip(reference, candidate)], dtype="Int32")


def character_distance(pairs: DataFrame) -> DataFrame:
    """Reference length and edit distance in characters, tokens joined by one space.

    Texts that are long on both sides are compared bit-wise, without their common ends; the built-in function
    goes through every cell.
    """
    joined = lambda column: F.array_join(F.transform(column, lambda t: t["normalized"]), " ")
    texts = pairs.withColumn("_ref", joined("ref")).withColumn("_cand", joined("cand"))
    texts = texts.withColumn("reference_characters", F.length("_ref"))
    many = F.col("reference_characters").cast("long") * F.length("_cand") > CELLS
    slow = _long_distance(F.when(many, F.col("_ref")), F.when(many, F.col("_cand")))
    short = lambda c: F.when(many, F.lit("")).otherwise(F.col(c))
    return texts.withColumn(
        "character_errors", F.coalesce(slow, F.levenshtein(short("_ref"), short("_cand")))
    ).drop("_ref", "_cand")


def _timed(steps: DataFrame) -> DataFrame:
    """Signed deltas of matches in which both sides have both times."""
    usable = (
        (F.col("operation") == "match")
        & F.col("ref.start").isNotNull() & F.col("ref.end").isNotNull()
        & F.col("cand.start").isNotNull() & F.col("cand.end").isNotNull()
    )
    onset = F.col("cand.start") - F.col("ref.start")
    offset = F.col("cand.end") - F.col("ref.end")
    length = (F.col("cand.end") - F.col("cand.start")) - (F.col("ref.end") - F.col("ref.start"))
    return steps.select(
        "*",
        F.when(usable, onset).alias("onset"), F.when(usable, offset).alias("offset"),
        F.when(usable, length).alias("duration"),
    )


def _counts() -> list[Column]:
    op = F.col("operation")
    return [
        F.count_if(op != "insertion").alias("reference_words"),
        F.count_if(op != "deletion").alias("candidate_words"),
        F.count_if(op == "match").alias("matches"),
        F.count_if(op == "substitution").alias("substitutions"),
        F.count_if(op == "deletion").alias("deletions"),
        F.count_if(op == "insertion").alias("insertions"),
        F.count("onset").alias("matched_words"),
    ]


def _means() -> list[Column]:
    return [
        F.avg("onset").alias("_onset_bias"), F.avg(F.abs("onset")).alias("_onset_mae"),
        F.avg("offset").alias("_offset_bias"), F.avg(F.abs("offset")).alias("_offset_mae"),
        F.avg(F.abs("duration")).alias("_duration_mae"),
        *[F.avg((F.abs("onset") <= limit).cast("int")).alias(f"_{name}")
          for name, limit in THRESHOLDS.items()],
    ]


def _finish(df: DataFrame, keys: list[str]) -> DataFrame:
    ms = lambda name: round_exact(F.col(f"_{name}") * 1000.0).alias(f"{name}_ms")
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    wide = df.withColumn("_wer", errors / F.col("reference_words")).withColumn(
        "_cer", F.col("character_errors") / F.greatest(F.lit(1), "reference_characters")
    ).withColumn("_coverage", F.col("matched_words") / F.col("reference_words"))
    return wide.select(
        *keys, "reference_words", "candidate_words", "matches", "substitutions", "deletions",
        "insertions", errors.alias("word_errors"), round_exact(F.col("_wer"), 6).alias("wer"),
        F.col("character_errors").cast("long").alias("character_errors"),
        round_exact(F.col("_cer"), 6).alias("cer"), "matched_words",
        round_exact(F.col("_coverage"), 6).alias("reference_coverage"),
        ms("onset_bias"), ms("onset_mae"), ms("onset_median"), ms("onset_p90"),
        ms("offset_bias"), ms("offset_mae"), ms("offset_median"), ms("offset_p90"),
        ms("duration_mae"),
        *[round_exact(F.col(f"_{name}"), 6).alias(name) for name in THRESHOLDS],
    )


def evaluate(reference: DataFrame, candidates: DataFrame, pairs: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """All metrics per (track, label); timing metrics are null without timed matches."""
    long = _split_pairs(reference, candidates, pairs, piece)
    few, named = _short(candidates, pairs, long)
    columns = ["track_id", "label", "character_errors", "reference_characters"]
    inner = character_distance(aligned_pairs(sequence_pairs(reference, few, named))).select(*columns, F.inline("steps"))
    if long is not None:
        keys = long.select("track_id", "label")
        whole = sequence_pairs(reference, candidates.join(keys, ["track_id", "label"], "left_semi"))
        lengths = stage(character_distance(whole).select(*columns), "characters")
        pieces = _steps_of_pieces(reference, candidates, long, piece).drop("step_no")
        inner = inner.unionByName(pieces.join(lengths, ["track_id", "label"]))
    steps = _timed(inner)
    half = lambda x, p: F.percentile(F.abs(x), F.lit(p))
    grouped = steps.groupBy("track_id", "label").agg(
        *_counts(), *_means(),
        half("onset", 0.5).alias("_onset_median"), half("onset", 0.9).alias("_onset_p90"),
        half("offset", 0.5).alias("_offset_median"), half("offset", 0.9).alias("_offset_p90"),
        F.first("character_errors").alias("character_errors"),
        F.first("reference_characters").alias("reference_characters"),
    )
    return _finish(grouped, ["track_id", "label"])


def leaderboard(steps: DataFrame, characters: DataFrame) -> DataFrame:
    """Corpus metrics per label from stored alignment steps.

    A label covers the whole corpus, so counts are summed map-side and the percentiles come
    from counted values instead of one buffer per label. ``characters`` has
    (track_id, label, character_errors, reference_characters).
    """
    timed = _timed(steps).withColumn("_ao", F.abs("onset")).withColumn("_af", F.abs("offset"))
    grouped = timed.groupBy("label").agg(*_counts(), *_means())
    onset = exact_percentiles(timed, ["label"], "_ao", {"_onset_median": 0.5, "_onset_p90": 0.9})
    offset = exact_percentiles(timed, ["label"], "_af", {"_offset_median": 0.5, "_offset_p90": 0.9})
    chars = characters.groupBy("label").agg(
        F.sum("character_errors").alias("character_errors"),
        F.sum("reference_characters").alias("reference_characters"),
    )
    wide = grouped.join(chars, "label").join(onset, "label", "left").join(offset, "label", "left")
    return _finish(wide, ["label"])
