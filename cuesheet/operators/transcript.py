"""Placed words of a track to its finished public words."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuesheet.operators.cleaning import adlib_filter, deduplicate_words, polish_timings, publish_words, with_defaults, with_norm
from cuesheet.plans.session import stage


def finish_words(placed: DataFrame) -> DataFrame:
    """Drop leaked ad-libs, polish each kind, drop repeats, and give the public shape.

    ``placed`` has (track_id, word_no, text, start, end, kind, phrase, source_layer, timing).
    It is read several times, so pass a stored table.
    """
    placed = with_defaults(placed)
    lead = placed.filter(F.col("kind") == "lead")
    adlibs = adlib_filter(placed.filter(F.col("kind") == "adlib"), lead)
    polished = stage(with_norm(polish_timings(lead.unionByName(adlibs))), "finished")
    kept = deduplicate_words(polished)
    return publish_words(kept.withColumnRenamed("phrase", "segment"))
