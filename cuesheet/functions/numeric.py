"""Column arithmetic: decimal rounding, clamps and millisecond views."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPLIT = 134217729.0  # 2**27 + 1, splits a double into two halves of 26 bits


def round_exact(x: Column, digits: int = 3, ties_up: bool = False) -> Column:
    """Round the binary value of ``x`` half-to-even, as IEEE correct rounding does.

    ``F.round`` rounds the shortest decimal form half-up, which differs on values such as
    2.6755 (stored slightly below the tie). ``x * 10**digits`` is split into the rounded
    product and its exact error; the error decides only when the product looks like a tie.
    ``ties_up`` sends true ties upwards, as decimal formatting does.
    """
    scale = float(10**digits)
    product = x * scale
    high = x * _SPLIT - (x * _SPLIT - x)
    error = (high * scale - product) + (x - high) * scale
    below = F.floor(product).cast("double")
    tie = product - below == 0.5
    if ties_up:
        units = F.when(tie & (error >= 0.0), below + 1.0).when(tie, below)
    else:
        units = F.when(tie & (error > 0.0), below + 1.0).when(tie & (error < 0.0), below)
    units = units.otherwise(F.rint(product))
    return units / scale


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def to_ms(x: Column) -> Column:
    """Seconds as whole milliseconds."""
    return F.rint(x * 1000.0).cast("long")


def to_ppm(x: Column) -> Column:
    """Shares as whole millionths, halves away from zero."""
    return F.round(x * 1e6).cast("long")


def clamp_progress(x: Column) -> Column:
    return clamp(x.cast("double"), 0.0, 100.0)
