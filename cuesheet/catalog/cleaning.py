"""Queries on word cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet import fixtures
from cuesheet.catalog import sql
from cuesheet.catalog.intervals import KEPT_ADLIBS
from cuesheet.catalog.registry import query
from cuesheet.functions.numeric import to_ms
from cuesheet.operators import cleaning as cl
from cuesheet.operators.transcript import finish_words
from cuesheet.plans.session import stage

R = sql.rounded


def _polish_steps(source):
    """CTEs that polish a word table by recursion: inside phrases, then between their edges."""
    return f"""
p1 AS (SELECT *, greatest(0e0, start - 0.055e0) AS s0 FROM {source}),
p2 AS (SELECT *, {R('s0')} AS s FROM p1),
p3 AS (SELECT *, greatest(s + 0.045e0, "end" + 0.018e0) AS e0 FROM p2),
p4 AS (SELECT *, {R('e0')} AS e, row_number() OVER (
         PARTITION BY track_id, kind, phrase ORDER BY start, "end", word_no) AS rn FROM p3),
walk AS (
  SELECT track_id, kind, phrase, rn, word_no, start, s, e, s AS x, CAST(NULL AS DOUBLE) AS prev_end
  FROM p4 WHERE rn = 1
  UNION ALL
  SELECT track_id, kind, phrase, rn, word_no, start, s, e,
         CASE WHEN overlap THEN {R('b6')} ELSE s END, CASE WHEN overlap THEN {R('b')} ELSE pe END
  FROM (SELECT *, b + 0.006e0 AS b6 FROM (
    SELECT n.track_id, n.kind, n.phrase, n.rn, n.word_no, n.start, n.s, n.e, w.e AS pe, n.s < w.e AS overlap,
           least(n.e - 0.04e0, greatest(w.x + 0.04e0, (w.e + n.s) / 2)) AS b
    FROM walk w JOIN p4 n ON n.track_id = w.track_id AND n.kind = w.kind AND n.phrase = w.phrase
      AND n.rn = w.rn + 1))),
inner_pass AS (
  SELECT *, coalesce(lead(prev_end) OVER (PARTITION BY track_id, kind, phrase ORDER BY rn), e) AS ne FROM walk),
edges AS (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY orig, phrase) AS rn FROM (
    SELECT track_id, phrase, min(start) AS orig, count(*) AS n, arg_min(x, rn) AS fs, arg_min(ne, rn) AS fe,
           arg_max(x, rn) AS ls, arg_max(ne, rn) AS le, arg_min(word_no, rn) AS fw, arg_max(word_no, rn) AS lw
    FROM inner_pass WHERE kind = 'lead' GROUP BY track_id, phrase)),
cross_pass AS (
  SELECT track_id, phrase, rn, n, fs, fe, ls, le, fw, lw, fs AS x, CAST(NULL AS DOUBLE) AS prev_end
  FROM edges WHERE rn = 1
  UNION ALL
  SELECT track_id, phrase, rn, n, fs, fe, ls, le, fw, lw,
         CASE WHEN overlap THEN {R('b6')} ELSE fs END, CASE WHEN overlap THEN {R('b')} ELSE pe END
  FROM (SELECT *, b + 0.006e0 AS b6 FROM (
    SELECT q.*, w.le AS pe, q.fs < w.le AS overlap,
           least(q.fe - 0.04e0, greatest(CASE WHEN w.n > 1 THEN w.ls ELSE w.x END + 0.04e0, (w.le + q.fs) / 2)) AS b
    FROM cross_pass w JOIN edges q ON q.track_id = w.track_id AND q.rn = w.rn + 1))),
outer_pass AS (
  SELECT *, coalesce(lead(prev_end) OVER (PARTITION BY track_id ORDER BY rn), le) AS ne FROM cross_pass)"""


_POLISHED = "inner_pass i LEFT JOIN outer_pass o ON i.kind = 'lead' AND o.track_id = i.track_id AND o.phrase = i.phrase"
_POLISHED_START = "CASE WHEN o.fw = i.word_no THEN o.x ELSE i.x END"
_POLISHED_END = "CASE WHEN o.lw = i.word_no THEN o.ne ELSE i.ne END"


@query(
    "q_polish",
    f"""WITH RECURSIVE {sql.WORDS},{_polish_steps('words')}
SELECT i.track_id, i.kind, i.word_no, {sql.ms(_POLISHED_START)} AS start_ms, {sql.ms(_POLISHED_END)} AS end_ms
FROM {_POLISHED}""",
)
def q_polish(spark, sf_dir):
    polished = cl.polish_timings(stage(fixtures.words(spark, sf_dir), "words"))
    return polished.select(
        "track_id", "kind", "word_no", to_ms(F.col("start")).alias("start_ms"),
        to_ms(F.col("end")).alias("end_ms"),
    )


def _dedup_steps(source):
    """CTEs that drop repeats by recursion; ``source`` has the normal form of a word as its text."""
    return f"""
ranked_words AS (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start, kind <> 'lead', "end", word_no) AS rn FROM {source}),
run AS (
  SELECT track_id, rn, word_no, "end", FALSE AS dup, word_no AS target,
    [struct_pack(t := text, k := kind, p := phrase, s := start, e := "end", w := word_no)] AS kept
  FROM ranked_words WHERE rn = 1
  UNION ALL
  SELECT track_id, rn, word_no, "end", hit IS NOT NULL, coalesce(hit.w, word_no),
    CASE WHEN hit IS NULL THEN list_append(kept, me)[-12:]
         ELSE list_transform(kept, lambda k: CASE WHEN k.w = hit.w
           THEN struct_pack(t := k.t, k := k.k, p := k.p, s := k.s, e := greatest(k.e, me.e), w := k.w)
           ELSE k END) END
  FROM (SELECT *, list_filter(kept, lambda k: k.t = me.t AND k.k = me.k
            AND (me.p < 0 OR k.p < 0 OR me.p <> k.p) AND abs(me.s - k.s) < 0.7e0
            AND (least(me.e, k.e) > greatest(me.s, k.s) OR abs(me.s - k.s) < 0.16e0))[-1] AS hit
    FROM (SELECT o.track_id, o.rn, o.word_no, o."end", r.kept,
            struct_pack(t := o.text, k := o.kind, p := o.phrase, s := o.start, e := o."end", w := o.word_no) AS me
          FROM run r JOIN ranked_words o ON o.track_id = r.track_id AND o.rn = r.rn + 1)))"""


@query(
    "q_dedup",
    f"""WITH RECURSIVE {sql.BEATS},{_dedup_steps('beats')}
SELECT track_id, target AS word_no, {sql.ms('max("end")')} AS end_ms FROM run GROUP BY track_id, target""",
)
def q_dedup(spark, sf_dir):
    kept = cl.deduplicate_words(fixtures.beats(spark, sf_dir))
    return kept.select("track_id", "word_no", to_ms(F.col("end")).alias("end_ms"))


@query(
    "q_resolve",
    f"""WITH RECURSIVE {sql.BEATS},
w AS (SELECT *, ((phrase * 37 + track_id) % 100) / 100e0 AS conf FROM beats),
ph AS (
  SELECT track_id, phrase, row_number() OVER (PARTITION BY track_id ORDER BY conf DESC, s, fw) AS rn,
    ws FROM (
    SELECT track_id, phrase, arg_min(conf, word_no) AS conf, min(start) AS s, min(word_no) AS fw,
      list(struct_pack(s := start, e := "end", w := word_no) ORDER BY start, "end", word_no) AS ws
    FROM w GROUP BY track_id, phrase)),
claim_step AS (
  SELECT track_id, 0 AS rn, CAST([] AS STRUCT(s DOUBLE, e DOUBLE)[]) AS claims,
         CAST([] AS STRUCT(s DOUBLE, e DOUBLE, w BIGINT)[]) AS kept FROM (SELECT DISTINCT track_id FROM w)
  UNION ALL
  SELECT track_id, rn, CASE WHEN len(kept) > 0 THEN list_append(claims,
      struct_pack(s := kept[1].s, e := list_max(list_transform(kept, lambda k: k.e)))) ELSE claims END, kept
  FROM (
    SELECT p.track_id, p.rn, c.claims,
      list_filter(list_transform(p.ws, lambda v: list_reduce(
        c.claims, lambda a, q: CASE
          WHEN a.lost THEN a
          WHEN q.s - 0.025e0 <= (a.s + a.e) / 2 AND (a.s + a.e) / 2 <= q.e + 0.025e0
            THEN struct_pack(s := a.s, e := a.e, w := a.w, lost := TRUE)
          ELSE struct_pack(
            s := CASE WHEN a.s < q.e AND q.e < a.e THEN round(q.e + 0.008e0, 3) ELSE a.s END,
            e := CASE WHEN a.s < q.s AND q.s < a.e THEN round(q.s - 0.008e0, 3) ELSE a.e END,
            w := a.w,
            lost := CASE WHEN a.s < q.s AND q.s < a.e THEN round(q.s - 0.008e0, 3) ELSE a.e END
                  - CASE WHEN a.s < q.e AND q.e < a.e THEN round(q.e + 0.008e0, 3) ELSE a.s END < 0.04e0)
          END,
        struct_pack(s := v.s, e := v.e, w := v.w, lost := FALSE))), lambda v: NOT v.lost) AS kept
    FROM claim_step c JOIN ph p ON p.track_id = c.track_id AND p.rn = c.rn + 1))
SELECT track_id, k.w AS word_no, {sql.ms('k.s')} AS start_ms, {sql.ms('k.e')} AS end_ms
FROM (SELECT track_id, UNNEST(kept) AS k FROM claim_step)""",
)
def q_resolve(spark, sf_dir):
    words = fixtures.beats(spark, sf_dir).select(
        "track_id", "word_no", "text", "start", "end", "kind",
        F.col("phrase").alias("segment"),
        (((F.col("phrase") * 37 + F.col("track_id")) % 100) / 100.0).alias("segment_confidence"),
    )
    return cl.resolve_overlaps(stage(words, "words")).select(
        "track_id", "word_no", to_ms(F.col("start")).alias("start_ms"),
        to_ms(F.col("end")).alias("end_ms"),
    )


@query(
    "q_publish",
    f"""WITH {sql.BEATS},
u AS (
  SELECT track_id, word_no, text, kind, phrase, start AS s, "end" AS e, k, start + (k - 1) * 0.03e0 AS us,
         start + (k - 1) * 0.03e0 + 0.05e0 AS ue, k / 4e0 AS fill
  FROM beats, (SELECT UNNEST(range(0, 5)) AS k)),
c AS (SELECT *, greatest(s, us) AS lo, least(e, ue) AS hi FROM u),
ok AS (SELECT * FROM c WHERE hi > lo AND fill > 0),
n AS (SELECT track_id, word_no, count(*) AS units, {sql.ms('min(lo)')} AS first_ms, {sql.ms('max(hi)')} AS last_ms
      FROM ok GROUP BY ALL)
SELECT b.track_id, b.word_no, b.kind, b.phrase, coalesce(units, 0) AS units, first_ms, last_ms,
       CASE WHEN units > 0 THEN 1000000 END AS last_fill_ppm
FROM beats b LEFT JOIN n USING (track_id, word_no)""",
)
def q_publish(spark, sf_dir):
    beats = fixtures.beats(spark, sf_dir)
    unit = lambda k: F.struct(
        (F.col("start") + (k - 1) * 0.03).alias("start"),
        (F.col("start") + (k - 1) * 0.03 + 0.05).alias("end"),
        (k / 4.0).alias("fill"), F.lit(False).alias("pause_before"),
    )
    raw = beats.withColumn("timing", F.transform(F.sequence(F.lit(0), F.lit(4)), unit))
    public = cl.publish_words(raw.withColumnRenamed("phrase", "segment"))
    first, last = F.get("timing", F.lit(0)), F.try_element_at("timing", F.lit(-1))
    return public.select(
        "track_id", "word_no", "kind", "phrase",
        F.coalesce(F.size("timing"), F.lit(0)).cast("long").alias("units"),
        to_ms(first["start"]).alias("first_ms"), to_ms(last["end"]).alias("last_ms"),
        F.rint(last["fill"] * 1e6).cast("int").alias("last_fill_ppm"),
    )


@query(
    "q_transcript",
    f"""WITH RECURSIVE {KEPT_ADLIBS},
chosen AS MATERIALIZED (
  SELECT * FROM words WHERE kind = 'lead' OR (track_id, phrase) IN (SELECT (track_id, phrase) FROM kept)),{_polish_steps('chosen')},
polished AS MATERIALIZED (
  SELECT i.track_id, i.word_no, i.kind, i.phrase, regexp_replace(lower(c.text), '[^\\p{{L}}\\p{{N}}_'']+', '', 'g') AS text,
    {_POLISHED_START} AS start, {_POLISHED_END} AS "end", c.start AS unit_start, c."end" AS unit_end
  FROM {_POLISHED} JOIN chosen c ON c.track_id = i.track_id AND c.word_no = i.word_no),
named AS (SELECT * FROM polished WHERE text <> ''),{_dedup_steps('named')},
ends AS (SELECT track_id, target AS word_no, max("end") AS "end" FROM run GROUP BY track_id, target)
SELECT track_id, word_no, kind, phrase, {sql.ms('start')} AS start_ms, {sql.ms('ends."end"')} AS end_ms,
  CASE WHEN least(ends."end", unit_end) > greatest(start, unit_start) THEN 1 END AS units
FROM ends JOIN named USING (track_id, word_no)""",
)
def q_transcript(spark, sf_dir):
    """The whole cleaning chain on conversation words."""
    words = stage(fixtures.words(spark, sf_dir), "words")
    unit = F.struct("start", "end", F.lit(1.0).alias("fill"), F.lit(False).alias("pause_before"))
    placed = words.withColumn(
        "source_layer", F.when(F.col("phrase") % 3 == 0, "center").otherwise("side")
    ).withColumn("timing", F.array(unit))
    return finish_words(placed).select(
        "track_id", "word_no", "kind", "phrase", to_ms(F.col("start")).alias("start_ms"),
        to_ms(F.col("end")).alias("end_ms"), F.size("timing").alias("units"),
    )
