"""Written numbers as spoken letters, for matching text with sound."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from cuesheet.constants import ONES, ORDINAL_ONES, ORDINAL_TENS, TENS
from cuesheet.functions.text import SPACE

# Letters without case that stand around a recognised number until it is spelled out.
OPEN, CLOSE = "ꙮ", "ꟷ"
_UNITS = {"$": "dollars", "£": "pounds", "€": "euros", "C": "percent", "N": ""}
_NUMBER = r"[0-9][0-9,]*+(?:\.[0-9]++)?+"
_BLANKS = SPACE[:-1] + "*"


def _other_digits() -> tuple[str, str]:
    """Decimal digits of all scripts but ASCII, and the ASCII digits of the same value."""
    digits = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.decimal(c)) for c in digits)


def _below_hundred(n: int) -> str:
    return ONES[n] if n < 20 else TENS[n // 10 - 2] + (ONES[n % 10] if n % 10 else "")


def _below_thousand(n: int) -> str:
    if n < 100:
        return _below_hundred(n)
    return ONES[n // 100] + "hundred" + (_below_hundred(n % 100) if n % 100 else "")


def _ordinal_below_thousand(n: int) -> str:
    if n >= 100:
        head = ONES[n // 100] + "hundred"
        return head + (_ordinal_below_thousand(n % 100) if n % 100 else "th")
    if n < 20:
        return ORDINAL_ONES[n]
    return ORDINAL_TENS[n // 10 - 2] if n % 10 == 0 else TENS[n // 10 - 2] + ORDINAL_ONES[n % 10]


_CARDINALS = [_below_thousand(n) for n in range(1000)]
_ORDINALS = [_ordinal_below_thousand(n) for n in range(1000)]
_TOKEN = re.compile(f"{OPEN}(.)([0-9.,]+){CLOSE}")


def _nine_digits(group: int) -> str:
    """Words of a group below 10**9, empty for zero."""
    million, thousand, rest = group // 1000000, group // 1000 % 1000, group % 1000
    return (
        (_CARDINALS[million] + "million" if million else "")
        + (_CARDINALS[thousand] + "thousand" if thousand else "")
        + (_CARDINALS[rest] if rest else "")
    )


def _nine_digits_ordinal(group: int) -> str:
    return _nine_digits(group - group % 1000) + (_ORDINALS[group % 1000] if group % 1000 else "th")


def _groups(digits: str) -> list[int]:
    """Groups of nine digits, highest first."""
    bare = digits.lstrip("0") or "0"
    first = len(bare) % 9 or 9
    return [int(bare[:first]), *[int(bare[i:i + 9]) for i in range(first, len(bare), 9)]]


def _chain(groups: list[int]) -> str:
    return "billion".join(map(_nine_digits, groups)) or ONES[0]


def integer_words(digits: str) -> str:
    """Spoken form of a digit string of any length; every group of nine counts billions."""
    return _chain(_groups(digits))


def ordinal_words(digits: str) -> str:
    *above, last = _groups(digits)
    if not above:
        return _nine_digits_ordinal(last) if last else ORDINAL_ONES[0]
    return _chain(above) + "billion" + _nine_digits_ordinal(last)


def decimal_words(clean: str) -> str:
    """Digits with at most one decimal point."""
    whole, point, digits = clean.partition(".")
    return integer_words(whole) + (point and "point" + "".join([ONES[int(d)] for d in digits]))


def _spelled(token: re.Match) -> str:
    tag, number = token[1], token[2].replace(",", "")
    return ordinal_words(number) if tag == "O" else decimal_words(number) + _UNITS[tag]


@F.pandas_udf(T.StringType())
def _spell_out(marked: pd.Series) -> pd.Series:
    return marked.map(lambda text: None if text is None else _TOKEN.sub(_spelled, text))


def _mark(text: Column, pattern: str, tag: str) -> Column:
    """Mark what ``pattern`` finds outside of earlier marks; its one group is the number.

    An earlier mark is matched first and put back, with an empty mark behind it that is taken away again.
    """
    found = F.regexp_replace(text, f"({OPEN}[^{CLOSE}]+{CLOSE})|{pattern}", f"$1{OPEN}{tag}$2{CLOSE}")
    return F.replace(found, F.lit(f"{OPEN}{tag}{CLOSE}"), F.lit(""))


def spoken_form(text: Column) -> Column:
    """Letters A-Z of the text with its numbers spelled out; digits of any script count.

    Passes in order: currency amounts, percentages, ordinals, other numbers. A pass puts marks around its
    matches, which later passes leave alone; at the end the marks are spelled out and everything else dropped.
    Only texts with digits pass through Python, which spells the marks.
    """
    digits, values = _other_digits()
    unusual = text.rlike(rf"[{OPEN}{CLOSE}\p{{Nd}}&&[^0-9]]")
    ascii_digits = F.when(unusual, F.translate(text, digits + OPEN + CLOSE, values + "ƻƻ")).otherwise(text)
    marked = F.regexp_replace(ascii_digits, rf"([$£€]){_BLANKS}({_NUMBER})", f"{OPEN}$1$2{CLOSE}")
    # what follows a number can't be part of it, so no shorter or later part of it fits either
    marked = _mark(marked, rf"(?<![0-9])({_NUMBER}){_BLANKS}%", "C")
    marked = _mark(marked, r"(?iU:\b([0-9][0-9,]*+)(?:st|nd|rd|th)\b)", "O")
    marked = _mark(marked, f"({_NUMBER})", "N")
    whole = F.coalesce(_spell_out(F.when(text.rlike(r"\p{Nd}"), marked)), text)
    return F.regexp_replace(F.upper(whole), "[^A-Z]+", "")
