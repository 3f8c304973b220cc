"""Consistent-hash ring with virtual nodes and bounded loads, by rows.

Every shard owns ``vnodes`` points of a ring; a key belongs to the first point clockwise. A shard
takes at most its share of the rows (shares differ by one row at most). Keys above a shard's share
go on clockwise, in order, to the next points whose shards have room. So loads are equal, and a
change of the shard count moves what the ring moves plus the overflow.

The walk needs only the number of keys on each arc: one row per piece of the ring, a number fixed
by the parameters. Ranks come from windows over small pieces of the ring, never over a shard.
Only DataFrame and SQL functions are used.

Defined results: the key is doc_id as text, 'null' where it is null; repeated rows are separate
rows of one key, ordered by (doc_id, checksum, size); a null text has size 1 and checksum 0. An
empty table gives no rows; very long texts are only measured and summed up. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cuesheet.plans.session import stage

SHARDS, VNODES, CELL_BITS, HASH_BITS = 16, 64, 14, 60


def _ring_hash(text: str) -> str:
    return f"cast(conv(substr(md5({text}), 1, 15), 16, 10) as bigint)"


def ring_pieces(spark: SparkSession, shards: int, vnodes: int, cell_bits: int) -> DataFrame:
    """(uid, arc, shard, cell, low, high): arcs cut at cell borders, numbered clockwise within each arc.
    A key lies in the piece of its cell with low < hash <= high. At most 2^cell_bits + 2 * points rows."""
    top, shift = (1 << HASH_BITS) - 1, HASH_BITS - cell_bits
    clockwise = W.orderBy("pos", "shard", "vnode")
    points = (
        spark.range(0, shards * vnodes, 1, 1)
        .selectExpr(f"cast(id div {vnodes} as int) shard", f"cast(id % {vnodes} as int) vnode")
        .withColumn("pos", F.expr(_ring_hash("concat('point/', shard, '/', vnode)")))
        .withColumn("arc", F.row_number().over(clockwise) - 1)
        .withColumn("low", F.coalesce(F.lag("pos").over(clockwise), F.lit(-1)))
    )
    last = points.groupBy().agg(F.max(F.struct("pos", "arc")).alias("m")).select(
        F.lit(0).alias("arc"), F.col("m.pos").alias("low"), F.lit(top).cast("long").alias("high"))
    arcs = points.select("arc", "shard", F.lit(1).alias("part"), "low", F.col("pos").alias("high")).unionByName(
        last.join(points.filter("arc = 0").select("arc", "shard"), "arc").withColumn("part", F.lit(0)))
    return (
        arcs.filter("high > low")
        .withColumn("cell", F.explode(F.expr(f"sequence(shiftright(greatest(low + 1, 0), {shift}), shiftright(high, {shift}))")))
        .withColumn("uid", F.row_number().over(W.orderBy("arc", "part", "cell")).cast("long"))
        .select("uid", "arc", "shard", "cell", "low", "high")
    )


def _placed_keys(docs: DataFrame, pieces: DataFrame, cell_bits: int) -> DataFrame:
    keyed = docs.withColumn("h", F.expr(_ring_hash("coalesce(cast(doc_id as string), 'null')"))).withColumn(
        "cell", F.expr(f"shiftright(h, {HASH_BITS - cell_bits})"))
    inside = (keyed["cell"] == pieces["cell"]) & (keyed["h"] > pieces["low"]) & (keyed["h"] <= pieces["high"])
    # the pieces' number is fixed by the parameters of the ring
    return keyed.join(F.broadcast(pieces.select("uid", "cell", "low", "high")), inside).drop("cell", "low", "high")


def ring_plan(counts: DataFrame, pieces: DataFrame, shards: int) -> DataFrame:
    """Where the keys of each piece go: (uid, base, kept, shard, home_slot, seq, steps).

    ``base`` keys of the arc come before the piece, the arc's first ``kept`` keys stay, and the k-th
    key after those is overflow number seq + k, which ``steps`` maps to a shard and a slot."""
    sized = pieces.select("uid", "arc", "shard").join(counts, "uid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    arcs = sized.groupBy("arc", "shard").agg(F.sum("n").alias("n"))
    loads = (
        arcs.withColumn("total", F.sum("n").over(W.partitionBy()))
        .withColumn("cap", F.expr(f"total div {shards} + if(shard < total % {shards}, 1, 0)"))
        .withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("arc").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("home", F.least(F.sum("n").over(W.partitionBy("shard")), "cap"))
        .withColumn("kept", F.expr("greatest(0, least(n, cap - before))"))
        .withColumn("over", F.expr("n - kept"))
        .withColumn("seq", F.coalesce(F.sum("over").over(W.orderBy("arc").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    )
    take = "least(a.carry + x.over, a.room[x.shard])"
    walk = loads.groupBy().agg(
        F.expr("array_sort(collect_list(struct(arc, shard, over)))").alias("lap"),
        F.expr("array_sort(collect_set(struct(shard, home, cap - home as room)))").alias("shards"),
    ).select(F.expr(f"""
        aggregate(
          concat(lap, transform(lap, x -> named_struct('arc', x.arc, 'shard', x.shard, 'over', 0L))),
          named_struct('room', transform(shards, s -> s.room), 'carry', 0L, 'placed', 0L,
                       'steps', cast(array() as array<struct<shard: int, first: bigint, after: bigint, slot: bigint>>)),
          (a, x) -> named_struct(
            'room', if({take} > 0, transform(a.room, (r, i) -> if(i = x.shard, r - {take}, r)), a.room),
            'carry', a.carry + x.over - {take},
            'placed', a.placed + {take},
            'steps', if({take} > 0, concat(a.steps, array(named_struct(
                'shard', x.shard, 'first', a.placed, 'after', a.placed + {take},
                'slot', shards[x.shard].home + shards[x.shard].room - a.room[x.shard]))), a.steps)),
          a -> a.steps)
    """).alias("steps"))
    steps = walk.select(F.explode("steps").alias("s"))
    meets = (F.col("over") > 0) & (F.col("s.first") < F.col("seq") + F.col("over")) & (F.col("s.after") > F.col("seq"))
    by_arc = loads.join(F.broadcast(steps), meets, "left").groupBy("arc", "shard", "kept", "seq", F.expr("least(before, cap)").alias("home_slot")).agg(
        F.collect_list("s").alias("steps"))
    base = F.coalesce(F.sum("n").over(W.partitionBy("arc").orderBy("uid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("base", base).filter("n > 0").select("uid", "arc", "base").join(by_arc, "arc").drop("arc")


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, cell_bits: int = CELL_BITS
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row."""
    spark = docs.sparkSession
    pieces = ring_pieces(spark, shards, vnodes, cell_bits)
    counts = stage(_placed_keys(docs.select("doc_id"), pieces, cell_bits).groupBy("uid").agg(F.count("*").alias("n")), "ring")
    plan = ring_plan(counts, pieces, shards)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = W.partitionBy("uid").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = _placed_keys(rows, pieces, cell_bits).withColumn("rank", F.row_number().over(order) - 1)
    # one row per piece of the ring: bounded by the parameters too
    return (
        ranked.join(F.broadcast(plan), "uid")
        .withColumn("k", F.expr("base + rank"))
        .withColumn("s", F.expr("if(k >= kept, filter(steps, s -> seq + k - kept >= s.first and seq + k - kept < s.after)[0], null)"))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
            F.expr("cast(if(k < kept, shard, s.shard) as int)").alias("shard"),
            F.expr("if(k < kept, home_slot + k, s.slot + seq + k - kept - s.first)").cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
