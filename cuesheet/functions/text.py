"""Text normal forms, tokenising and title handling as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cuesheet.constants import HALLUCINATIONS
from cuesheet.functions.numeric import round_exact
from cuesheet.plans.dictionary import by_dictionary

# Character classes: letters and all numbers count as word characters, marks do not.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: The characters of that class.
SPACES = "".join(chr(c) for c in (
    *range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
ALNUM = r"[\p{L}\p{N}]"
NOT_WORD = r"[^\p{L}\p{N}_]+"
NOT_WORD_OR_APOSTROPHE = r"[^\p{L}\p{N}_']+"
ASCII_ONLY = r"^[\x00-\x7F]*$"


@F.pandas_udf(T.StringType())
def _nfkc_casefold(values: pd.Series) -> pd.Series:
    return values.map(
        lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold()
    )


def fold_unicode(text: Column, ascii_only: bool = False) -> Column:
    """NFKC + casefold. ASCII text stays in the JVM: the Arrow UDF sees nulls for it."""
    if ascii_only:
        return F.lower(text)
    folded = _nfkc_casefold(F.when(~text.rlike(ASCII_ONLY), text))
    return F.coalesce(folded, F.lower(text))


def with_folded(df: DataFrame, text: Column, name: str, ascii_only: bool = False) -> DataFrame:
    """Add ``name``, NFKC + casefold of ``text``. Only the distinct values beyond ASCII pass through Python."""
    if ascii_only:
        return df.withColumn(name, F.lower(text))
    folded = by_dictionary(df, text, name, _nfkc_casefold, lambda value: ~value.rlike(ASCII_ONLY))
    return folded.withColumn(name, F.coalesce(name, F.lower(text)))


def evaluation_form(folded: Column) -> Column:
    """The normal form for comparisons of text that is folded."""
    straight = F.regexp_replace(F.replace(folded, F.lit("’"), F.lit("'")), "_", "")
    return F.regexp_replace(straight, NOT_WORD_OR_APOSTROPHE, "")


def concat_form(folded: Column) -> Column:
    return F.regexp_replace(folded, NOT_WORD, "")


def normalize_for_evaluation(text: Column, ascii_only: bool = False) -> Column:
    return evaluation_form(fold_unicode(F.coalesce(text, F.lit("")), ascii_only))


def normalize_for_dedup(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), NOT_WORD_OR_APOSTROPHE, "")


def normalize_for_interjection(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]+", "")


def normalize_for_concat(text: Column, ascii_only: bool = False) -> Column:
    return concat_form(fold_unicode(text, ascii_only))


def strip_space(text: Column) -> Column:
    """Trim every Unicode space, not only U+0020."""
    return F.btrim(text, F.lit(SPACES))


def pieces(text: Column) -> Column:
    """Whitespace-separated pieces that hold at least one letter or number."""
    return F.filter(F.split(strip_space(text), SPACE), lambda p: p.rlike(ALNUM))


def piece_weight(piece: Column) -> Column:
    letters = F.length(F.regexp_replace(piece, r"[^\p{L}\p{N}]+", "")).cast("double")
    return F.greatest(F.lit(1.0), F.pow(letters, F.lit(0.72)))


def is_hallucination(text: Column) -> Column:
    return text.rlike("(?i)(?:" + "|".join(HALLUCINATIONS) + ")")


def letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", "")


def ascii_letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+", "")


def strip_ansi(line: Column) -> Column:
    return F.regexp_replace(line, "\\x1b\\[[0-9;]*[A-Za-z]", "")


def short_model(model_id: Column) -> Column:
    return F.substring_index(model_id, "/", -1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(name), r"(?s).\.([^.]+)$", 1))


def track_title(filename: Column) -> Column:
    """``title - artist`` file names as struct(title, artist)."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(filename, r"\.[^.]+$", ""), "_+", " "))
    parts = F.split(clean, r"\s+-\s+")
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " — ")
    named = F.size(parts) > 1
    return F.struct(
        F.when(named, parts[0])
        .otherwise(F.coalesce(F.nullif(clean, F.lit("")), F.lit("Untitled track")))
        .alias("title"),
        F.when(named, rest).otherwise(F.lit("Local audio")).alias("artist"),
    )


def safe_title(title: Column) -> Column:
    dashed = F.regexp_replace(title, "(?i)[^a-z0-9_-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-|-$", ""), F.lit("")), F.lit("lyrics"))


def lrc_stamp(seconds: Column) -> Column:
    """``[MM:SS.cc]``; seconds are rounded after the minutes are taken off."""
    minutes = F.floor(seconds / 60.0)
    rest = F.format_string("%.2f", round_exact(F.pmod(seconds, F.lit(60.0)), 2, ties_up=True))
    return F.concat(
        F.lit("["),
        F.when(minutes < 10, F.concat(F.lit("0"), minutes.cast("string")))
        .otherwise(minutes.cast("string")),
        F.lit(":"),
        F.when(F.length(rest) < 5, F.lpad(rest, 5, "0")).otherwise(rest),
        F.lit("]"),
    )
