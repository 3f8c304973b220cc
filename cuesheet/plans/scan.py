"""Ordered scans that never put one key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here each key is
cut into *blocks* of its order axis (a time bucket, a frame range). A scan then has three
parts: windows inside (key, block); one summary row per (key, block), pre-aggregated before
its shuffle, scanned per key; and a join that hands each block what came before it. The
rows themselves are shuffled once, on (key, block), and joined in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

BLOCK = "_block"


def with_block(df: DataFrame, axis: Column, width: float) -> DataFrame:
    """Add the block number. ``axis`` must be the leading order column."""
    return df.withColumn(BLOCK, F.floor(axis / F.lit(float(width))).cast("long"))


@dataclass(frozen=True)
class Running:
    """One output of a scan: ``how`` in sum, count, max, last (last non-null value)."""

    name: str
    how: str
    value: Column
    inclusive: bool = True


def _local(item: Running, window) -> Column:
    frame = window.rowsBetween(W.unboundedPreceding, 0 if item.inclusive else -1)
    if item.how in ("sum", "count"):
        return F.sum(item.value).over(frame)
    if item.how == "max":
        return F.max(item.value).over(frame)
    return F.last(item.value, ignorenulls=True).over(frame)


def _summary(item: Running, order: list[Column], backwards: bool = False) -> Column:
    if item.how in ("sum", "count"):
        return F.sum(item.value)
    if item.how == "max":
        return F.max(item.value)
    key = F.when(item.value.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return F.min_by(item.value, key) if backwards else F.max_by(item.value, key)


def _carry(item: Running, column: Column, before) -> Column:
    if item.how in ("sum", "count"):
        return F.sum(column).over(before)
    if item.how == "max":
        return F.max(column).over(before)
    return F.last(column, ignorenulls=True).over(before)


def _merge(item: Running, local: Column, carried: Column) -> Column:
    if item.how in ("sum", "count"):
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
    if item.how == "max":
        return F.greatest(local, carried)  # greatest skips nulls
    return F.coalesce(local, carried)


_WHOLE_KEY, _WHOLE_BLOCK = "_whole_key", "_whole_block"
_RUN = 256


def _whole_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Keys and block as structs: a struct that holds a null equals another such struct, so rows
    with null keys or blocks stay together when summaries are joined back."""
    return df.withColumns({_WHOLE_KEY: F.struct(*keys), _WHOLE_BLOCK: F.struct(BLOCK)}), [_WHOLE_KEY]


def counted_steps(df: DataFrame, keys: list[str], order: list[str], value: str, stepped, name: str) -> DataFrame:
    """Running count of rows where ``stepped(value before, value)`` holds, in one ordered pass; ``value`` has no nulls.

    Steps inside blocks are counted there; a step between two blocks shows in the first and last values of
    their summaries."""
    given, (df, keys) = df.columns, _whole_keys(df, keys)
    sure = lambda before, now: F.coalesce(stepped(before, now), F.lit(False)).cast("long")
    inside = W.partitionBy(*keys, _WHOLE_BLOCK).orderBy(*order)
    counted = df.withColumn("_hit", sure(F.lag(value).over(inside), F.col(value))).withColumn(
        "_hits", F.sum("_hit").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    blocks = counted.groupBy(*keys, _WHOLE_BLOCK).agg(
        F.min_by(value, F.struct(*order)).alias("_first"), F.max_by(value, F.struct(*order)).alias("_last"),
        F.sum("_hit").alias("_total"))
    along = W.partitionBy(*keys).orderBy(_WHOLE_BLOCK)
    carried = blocks.withColumn("_edge", sure(F.lag("_last").over(along), F.col("_first"))).select(
        *keys, _WHOLE_BLOCK,
        (F.sum(F.col("_total") + F.col("_edge")).over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("_total")).alias("_before"))
    return counted.join(carried, [*keys, _WHOLE_BLOCK]).select(*given, (F.col("_hits") + F.col("_before")).alias(name))


def running(
    df: DataFrame, keys: list[str], order: list[str], outputs: list[Running],
    backwards: bool = False,
) -> DataFrame:
    """Running aggregates along ``order`` per key; ``df`` carries a block column.

    ``backwards`` scans from the last row to the first. The summaries grow with the keys, so they are merged with the rows,
    which are sorted by block already, and never broadcast.
    """
    order_columns = [F.col(o) for o in order]
    facing = F.desc if backwards else F.asc
    given, (df, keys) = df.columns, _whole_keys(df, keys)
    local_window = W.partitionBy(*keys, _WHOLE_BLOCK).orderBy(*[facing(o) for o in order])
    scanned = df.select(
        "*", *[_local(o, local_window).alias(f"_l_{o.name}") for o in outputs]
    )
    before = W.partitionBy(*keys).orderBy(facing(_WHOLE_BLOCK)).rowsBetween(W.unboundedPreceding, -1)
    carried = (
        df.groupBy(*keys, _WHOLE_BLOCK)
        .agg(*[_summary(o, order_columns, backwards).alias(f"_s_{o.name}") for o in outputs])
        .select(
            *keys,
            _WHOLE_BLOCK,
            *[_carry(o, F.col(f"_s_{o.name}"), before).alias(f"_c_{o.name}") for o in outputs],
        )
    )
    return scanned.join(carried.hint("merge"), [*keys, _WHOLE_BLOCK]).select(
        *given,
        *[
            _merge(o, F.col(f"_l_{o.name}"), F.col(f"_c_{o.name}")).alias(o.name)
            for o in outputs
        ],
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """0-based position of each row along ``order`` per key."""
    return running(df, keys, order, [Running(name, "count", F.lit(1).cast("long"), False)])


def following(df: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str):
    """The next row as a struct of ``columns``; null on a key's last row."""
    row = F.struct(*[F.col(c) for c in columns])
    return running(df, keys, order, [Running(name, "last", row, False)], backwards=True)


def running_clamp(
    df: DataFrame, keys: list[str], order: list[str], first: str, low: str, high: str, more: str,
    shift: int, name: str,
) -> DataFrame:
    """Solve ``x[i+1] = min(high[i], max(low[i], x[i] + shift))`` along ``order`` per key.

    ``x`` starts at the key's first value of ``first``; all four are whole numbers. ``more``
    tells whether the key goes on after a row. Such steps compose to steps of the same form,
    so a block is summed up by (rows, low, high) and the blocks are chained; each block then
    runs its own steps from a known value.
    """
    row = F.struct(*[F.col(o) for o in order], *[F.col(c) for c in df.columns
                   if c not in (*order, *keys, BLOCK)])
    named, given = keys, df.columns
    df, keys = _whole_keys(df, keys)
    blocks = df.groupBy(*keys, _WHOLE_BLOCK).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    limit = lambda r, value: F.least(r[high], F.greatest(r[low], value))
    whole = F.aggregate(
        "_rows",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-(10**17)).alias("lo"), F.lit(10**17).alias("hi")),
        lambda acc, r: F.struct(
            (acc["n"] + shift).alias("n"), limit(r, acc["lo"] + shift).alias("lo"),
            limit(r, acc["hi"] + shift).alias("hi"),
        ),
    )
    summed = F.struct(
        F.col(_WHOLE_BLOCK).alias("block"),
        F.element_at("_rows", 1)[first].alias("first"),
        F.when(F.element_at("_rows", -1)[more], whole).alias("w"),  # a key's last block leads nowhere
    )
    entries = F.aggregate(
        F.array_sort(F.collect_list(summed)),
        F.struct(
            F.lit(None).cast("long").alias("x"),
            F.array().cast(f"array<struct<{_WHOLE_BLOCK}:struct<{BLOCK}:bigint>,_x:bigint>>").alias("entries"),
        ),
        lambda acc, b: F.struct(
            F.least(b["w"]["hi"], F.greatest(b["w"]["lo"], F.coalesce(acc["x"], b["first"]) + b["w"]["n"])).alias("x"),
            F.array_append(
                acc["entries"],
                F.struct(b["block"].alias(_WHOLE_BLOCK), F.coalesce(acc["x"], b["first"]).alias("_x")),
            ).alias("entries"),
        ),
        lambda acc: acc["entries"],
    )
    known = blocks.groupBy(*keys).agg(entries.alias("_e")).select(*keys, F.inline("_e"))
    # runs of 256 rows: appending to a run's own short array keeps a long block linear
    known_x = lambda x, out: F.struct(x.alias("x"), out.alias("out"))
    solve = lambda rows, x: F.aggregate(
        rows, known_x(x, F.array().cast("array<bigint>")),
        lambda acc, r: known_x(limit(r, acc["x"] + shift), F.array_append(acc["out"], acc["x"])),
    )
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / _RUN).cast("int")),
        lambda i: F.slice("_rows", i * _RUN + 1, _RUN))
    solutions = F.aggregate(
        runs, F.array(known_x(F.col("_x"), F.array().cast("array<bigint>"))),
        lambda acc, rows: F.array_append(acc, solve(rows, F.element_at(acc, -1)["x"])),
    )
    values = F.flatten(F.transform(solutions, lambda s: s["out"]))
    solved = blocks.join(known, [*keys, _WHOLE_BLOCK]).select(
        *keys, F.inline(F.arrays_zip(F.col("_rows").alias("row"), values.alias("x")))
    )
    return solved.select(f"{_WHOLE_KEY}.*", "row.*", F.col("x").alias(name)).select(
        *named, *[c for c in (*order, *[c for c in given if c not in (*order, *named, BLOCK)])], name)


def linked_clamp(
    df: DataFrame, keys: list[str], order: list[str], ahead: list[str], first: str, bounds, shift: int,
    next_name: str, name: str,
) -> DataFrame:
    """Next row of each row (struct of ``ahead``) as ``next_name``, and the solution of ``running_clamp`` as ``name``.

    ``bounds`` makes (low, high) from the next row. A key that lies in one block is sorted once and solved in a single pass
    over its sorted rows, which holds one number; only keys of several blocks are cut and chained. ``df`` is read several times.
    """
    given = df.columns
    named = df.withColumn(_WHOLE_KEY, F.struct(*keys))
    several = named.groupBy(_WHOLE_KEY).agg(F.min(BLOCK).alias("_a"), F.max(BLOCK).alias("_b")).filter("_a < _b").select(_WHOLE_KEY)
    low, high = bounds(F.col(next_name))

    long = following(named.join(several, _WHOLE_KEY, "left_semi").drop(_WHOLE_KEY), keys, order, ahead, next_name)
    limits = [low.alias("_lo"), high.alias("_hi"), F.col(next_name).isNotNull().alias("_more")]
    chained = running_clamp(long.select("*", *limits), keys, order, first, "_lo", "_hi", "_more", shift, name)

    # by the plain keys, which sort faster than their struct; rows with null keys are one partition of a window, too
    along = W.partitionBy(*keys).orderBy(*order)
    short = named.join(several, _WHOLE_KEY, "left_anti").drop(_WHOLE_KEY).select(
        "*", F.lead(F.struct(*ahead)).over(along).alias(next_name), (F.row_number().over(along) == 1).alias("_starts"))
    short = short.select("*", low.alias("_lo"), high.alias("_hi")).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = 0
        for batch in batches:
            found = []
            for starts, entry, least, most in zip(*(batch.column(c).to_pylist() for c in ("_starts", first, "_lo", "_hi"))):
                if starts:
                    x = entry
                found.append(x)
                x = min(most, max(least, x + shift))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, name])

    solved = short.mapInArrow(run, T.StructType([*short.schema.fields, T.StructField(name, T.LongType())]))
    out = [*[c for c in given if c != BLOCK], next_name, name]
    return solved.select(*out).unionByName(chained.select(*out))


def cut_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    carry_columns: list[str],
    cut,
    name: str,
    running_max: str | None = None,
) -> DataFrame:
    """Split each key into the groups that ``cut(before, row)`` separates (gaps and islands).

    ``before`` is the previous row (struct of ``carry_columns``) or, with ``running_max``,
    a struct whose field of that name is the largest value so far (``cut`` may then use order
    columns of ``row`` only). Adds ``name``, the order
    struct of the group's first row, and ``{name}_pos``, the 0-based position inside the
    group. Each block works out its inner cuts; whether its first row starts a group follows
    from the block summaries alone, so one pass over the rows is enough.
    """
    given, (df, keys) = df.columns, _whole_keys(df, keys)
    window = W.partitionBy(*keys, _WHOLE_BLOCK).orderBy(*order)
    so_far = window.rowsBetween(W.unboundedPreceding, 0)
    position = F.struct(*[F.col(o) for o in order])
    row = F.struct(*[F.col(c) for c in carry_columns])

    if running_max:
        before_local = F.struct(
            F.max(running_max).over(window.rowsBetween(W.unboundedPreceding, -1)).alias(running_max)
        )
    else:
        before_local = F.lag(row, 1).over(window)
    marked = df.select(
        "*",
        before_local.alias("_before"),
        F.row_number().over(window).cast("long").alias("_n"),
    ).withColumn(
        "_start",
        F.when(
            (F.col("_n") > 1) & cut(F.col("_before"), row),
            F.struct(position.alias("at"), F.col("_n").alias("n")),
        ),
    )
    local = marked.select(
        *df.columns, "_n", F.last("_start", ignorenulls=True).over(so_far).alias("_local")
    )

    summaries = marked.groupBy(*keys, _WHOLE_BLOCK).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max("_start").alias("_last"),
        F.min_by(row, position).alias("_head"),
        F.min(position).alias("_head_at"),
        (
            F.struct(F.max(running_max).alias(running_max))
            if running_max
            else F.max_by(row, position)
        ).alias("_tail"),
    )
    blocks = W.partitionBy(*keys).orderBy(_WHOLE_BLOCK)
    upto = blocks.rowsBetween(W.unboundedPreceding, -1)
    if running_max:
        entering = F.struct(F.max(f"_tail.{running_max}").over(upto).alias(running_max))
    else:
        entering = F.lag("_tail", 1).over(blocks)

    def still_cut(start: str) -> Column:
        """An inner cut under a running maximum must also clear the maximum carried in.
        Order values ascend, so the latest inner cut that clears it is the latest of all."""
        found = F.col(start).isNotNull()
        if not running_max:
            return found
        return found & (
            F.col(f"_entering.{running_max}").isNull()
            | cut(F.col("_entering"), F.col(f"{start}.at"))
        )

    opened = summaries.select(
        "*",
        entering.alias("_entering"),
        F.row_number().over(blocks).alias("_block_no"),
        F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_offset"),
    ).withColumn(
        "_opening",
        F.when(
            (F.col("_block_no") == 1) | cut(F.col("_entering"), F.col("_head")),
            F.struct(F.col("_head_at").alias("at"), (F.col("_offset") + 1).alias("n")),
        ),
    ).withColumn(
        "_closing",
        F.coalesce(
            F.when(
                still_cut("_last"),
                F.struct(
                    F.col("_last.at").alias("at"),
                    (F.col("_offset") + F.col("_last.n")).alias("n"),
                ),
            ),
            F.col("_opening"),
        ),
    )
    carried = opened.select(
        *keys,
        _WHOLE_BLOCK,
        "_offset",
        "_entering",
        F.coalesce("_opening", F.last("_closing", ignorenulls=True).over(upto)).alias("_carried"),
    )
    inside = still_cut("_local")
    return local.join(carried, [*keys, _WHOLE_BLOCK]).select(
        *given,
        F.when(inside, F.col("_local.at")).otherwise(F.col("_carried.at")).alias(name),
        F.when(inside, F.col("_n") - F.col("_local.n"))
        .otherwise(F.col("_offset") + F.col("_n") - F.col("_carried.n"))
        .alias(f"{name}_pos"),
    )
