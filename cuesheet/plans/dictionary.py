"""Costly column functions, computed once for each distinct value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def by_dictionary(df: DataFrame, value: Column, name: str, make: Callable[[Column], Column], needed: Callable[[Column], Column]) -> DataFrame:
    """Add ``name``: ``make`` of ``value`` where ``needed``, else null.

    The distinct values form a dictionary, which is joined back on the value, so ``make`` sees none twice. Other rows match
    nothing there; they join on their own value too, so they do not meet in one task. ``df`` is read twice, for the
    dictionary in the columns of ``value`` only. A small dictionary is broadcast by adaptive execution; beside a large one it splits
    the rows of a hot value, as the dictionary has one row for it.
    """
    key, made = f"_{name}_key", f"_{name}_made"
    distinct = df.select(value.alias(key)).filter(needed(F.col(key))).distinct()
    dictionary = distinct.select(F.col(key).alias(made), make(F.col(key)).alias(name))
    return df.withColumn(key, value).join(dictionary, F.col(key) == F.col(made), "left").select(*df.columns, name)
