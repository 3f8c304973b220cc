"""Cutting long pairs of token sequences where every minimum-edit path must pass.

A run is a stretch of ``length`` tokens that both sequences share on one diagonal, and in which every group of ``GRAM``
tokens occurs once in either sequence. A path that misses a run's diagonal has an error in each of its
``length div GRAM`` groups, as none of them is found elsewhere. Between neighbouring runs of a chain some path needs
no more edits than the longer side of the gap has tokens. So a cheapest path that joins a run after missing others
owes at most the gaps since the run it left, less the errors of the missed ones; call that d. It misses at
most ``GRAM * (d + 1) - 1`` tokens at the run's start, and as many with the d of the other direction at its end. Where
the run is longer than both, the token between is on every cheapest path. Cut there, pieces are aligned on their own, and their
paths together are the path of the whole pair, ties included: predecessors of equal cost lie on cheapest paths too.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from cuesheet.plans.scan import Running, cut_groups, running, with_block
from cuesheet.plans.session import stage

GRAM = 4
#: Tokens of either side between two cuts, at least.
PIECE = 4096


def _chain(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The longest list of runs that follow one another on both sides."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(runs)
    runs = sorted(runs)
    for n, (_, j, length) in enumerate(runs):
        at = bisect_left(ends, j + 1)
        before[n] = last[at - 1] if at else -1
        if at == len(ends):
            ends.append(j + length)
            last.append(n)
        elif j + length < ends[at]:
            ends[at], last[at] = j + length, n
    chosen, n = [], last[-1] if last else -1
    while n >= 0:
        if not chosen or runs[n][0] + runs[n][2] <= chosen[-1][0]:
            chosen.append(runs[n])
        n = before[n]
    return chosen[::-1]


def certain_cuts(runs: list[tuple[int, int, int]], n: int, m: int, gram: int = GRAM) -> list[tuple[int, int]]:
    """Cells (i, j) through which every cheapest path of n by m tokens goes, from runs (i, j, length)."""
    chain = _chain(runs)
    places = [(0, 0, 0), *chain, (n, m, 0)]
    gaps = [max(k - i - length, l - j - length) for (i, j, length), (k, l, _) in zip(places, places[1:])]
    errors = [length // gram for _, _, length in chain]

    def owed(gaps: list[int], errors: list[int]) -> list[int]:
        """The most that a cheapest path can pay before it joins each run, over what missing the ones before costs."""
        out = []
        for gap in gaps:
            out.append(gap + (max(0, out[-1] - errors[len(out) - 1]) if out else 0))
        return out

    ahead, behind = owed(gaps[:-1], errors), owed(gaps[:0:-1], errors[::-1])[::-1]
    cuts = []
    for (i, j, length), before, after in zip(chain, ahead, behind):
        step = gram * (before + 1) - 1
        if step <= length - gram * (after + 1):
            cuts.append((i + step, j + step))
    return cuts


_CUT = T.StructType([T.StructField("number", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("i", "j", "to_i", "to_j"))])


@F.pandas_udf(T.ArrayType(_CUT))
def _pieces(runs: pd.Series, n: pd.Series, m: pd.Series, piece: pd.Series) -> pd.Series:
    def cut(found, n, m, piece):
        at, out = (0, 0), []
        for i, j in certain_cuts([(r["i"], r["j"], r["length"]) for r in found], n, m):
            if i - at[0] >= piece and j - at[1] >= piece:
                out.append((*at, i, j))
                at = (i, j)
        out.append((*at, n, m))
        return [{"number": k, "i": a, "j": b, "to_i": c, "to_j": d} for k, (a, b, c, d) in enumerate(out)]

    return pd.Series([cut(*row) for row in zip(runs, n, m, piece)])


def numbered(tokens: DataFrame, keys: list[str], block: int = PIECE) -> DataFrame:
    """Add ``idx``, the token's place in its sequence, from 0. ``pos`` orders a sequence."""
    blocked = with_block(tokens, F.col("pos"), float(block))
    counted = running(blocked, keys, ["pos"], [Running("idx", "count", F.lit(1).cast("long"))])
    return counted.select(*tokens.columns, (F.col("idx") - 1).alias("idx"))


def _grams(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gram, idx) of the groups of tokens that occur once in their sequence."""
    block = F.col("idx") - F.col("idx") % PIECE
    spread = tokens.withColumn("block", F.explode(F.array_compact(F.array(
        block, F.when((F.col("idx") % PIECE < GRAM - 1) & (block > 0), block - PIECE)))))
    rows = spread.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("idx", "normalized"))).alias("rows"))
    grams = F.expr(f"""transform(sequence(1, least({PIECE}, size(rows) - {GRAM - 1})), k -> named_struct(
        'idx', element_at(rows, k).idx, 'gram', transform(slice(rows, k, {GRAM}), r -> r.normalized)))""")
    each = rows.filter(F.size("rows") >= GRAM).select(*keys, F.inline(grams))
    return each.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("idx")).filter("n = 1").drop("n")


def pieces_of_pairs(reference: DataFrame, candidates: DataFrame, sizes: DataFrame, piece: int = PIECE) -> DataFrame:
    """(track_id, label, number, i, j, to_i, to_j): the pieces of each pair of ``sizes`` (track_id, label, n, m).

    ``reference`` and ``candidates`` are numbered tokens. What one row holds for a pair is its runs, not its tokens.
    """
    pair = ["track_id", "label"]
    once = _grams(reference, ["track_id"]).withColumnRenamed("idx", "i")
    anchors = _grams(candidates, pair).withColumnRenamed("idx", "j").join(once, ["track_id", "gram"]).select(
        *pair, "i", "j", (F.col("j") - F.col("i")).alias("diagonal"))
    on_line = cut_groups(
        with_block(anchors, F.col("i"), float(PIECE)), [*pair, "diagonal"], ["i"], ["i"],
        lambda before, row: row["i"] > before["i"] + 1, "run")
    runs = on_line.groupBy(*pair, "diagonal", "run").agg(
        F.min("i").alias("i"), F.min("j").alias("j"), (F.count(F.lit(1)) + GRAM - 1).alias("length"))
    listed = runs.groupBy(*pair).agg(F.collect_list(F.struct("i", "j", "length")).alias("runs"))
    none = F.array().cast("array<struct<i:bigint,j:bigint,length:bigint>>")
    listed = sizes.join(listed, pair, "left").withColumn("runs", F.coalesce("runs", none))
    return listed.select(*pair, F.inline(_pieces("runs", "n", "m", F.lit(piece))))


def in_pieces(tokens: DataFrame, pieces: DataFrame, keys: list[str], first: str, after: str, piece: int = PIECE) -> DataFrame:
    """(track_id, label, number) of each token of ``keys``, whose place lies in [first, after) of the piece."""
    ranges = pieces.filter(F.col(first) < F.col(after)).select(
        "track_id", "label", "number", F.col(first).alias("_first"), F.col(after).alias("_after"),
        F.explode(F.sequence(F.expr(f"{first} div {piece}"), F.expr(f"({after} - 1) div {piece}"))).alias("_bucket"))
    bucketed = tokens.withColumn("_bucket", F.expr(f"idx div {piece}"))
    joined = bucketed.join(ranges, [*keys, "_bucket"])
    return joined.filter((F.col("idx") >= F.col("_first")) & (F.col("idx") < F.col("_after"))).drop("_bucket", "_first", "_after")


def cut_long_pairs(reference: DataFrame, candidates: DataFrame, sizes: DataFrame, piece: int = PIECE) -> DataFrame:
    """(track_id, label, number, ref, cand): both token lists of every piece of the pairs ``sizes``."""
    pair = ["track_id", "label"]
    ref = stage(numbered(reference.join(sizes.select("track_id").distinct(), "track_id", "left_semi"), ["track_id"]), "numbered")
    cand = stage(numbered(candidates.join(sizes.select(*pair), pair, "left_semi"), pair), "numbered")
    pieces = stage(pieces_of_pairs(ref, cand, sizes, piece), "pieces")
    token = F.struct("pos", "text", "normalized", "start", "end", "kind")

    def lists(tokens: DataFrame, name: str) -> DataFrame:
        return tokens.groupBy(*pair, "number").agg(F.array_sort(F.collect_list(token)).alias(name))

    left = lists(in_pieces(ref, pieces, ["track_id"], "i", "to_i", piece), "ref")
    right = lists(in_pieces(cand, pieces, pair, "j", "to_j", piece), "cand")
    joined = pieces.select(*pair, "number").join(left, [*pair, "number"], "left").join(right, [*pair, "number"], "left")
    empty = F.array().cast(left.schema["ref"].dataType)
    return joined.select(*pair, "number", F.coalesce("ref", empty).alias("ref"), F.coalesce("cand", empty).alias("cand"))
