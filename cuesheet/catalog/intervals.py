"""Queries on intervals and probe times."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet import fixtures
from cuesheet.catalog import sql
from cuesheet.catalog.registry import query
from cuesheet.functions.numeric import to_ms, to_ppm
from cuesheet.operators import intervals as iv
from cuesheet.operators.cleaning import adlib_filter
from cuesheet.plans.session import stage

DAY = 86400.0


@query(
    "q_prefix_max",
    f"""WITH {sql.INTERVALS}
SELECT track_id, interval_id,
  row_number() OVER (PARTITION BY track_id ORDER BY start, "end", interval_id) - 1 AS idx,
  {sql.ms('max("end") OVER (PARTITION BY track_id ORDER BY start, "end", interval_id ROWS UNBOUNDED PRECEDING)')}
    AS prefix_max_end_ms
FROM intervals""",
)
def q_prefix_max(spark, sf_dir):
    table = iv.indexed(fixtures.intervals(spark, sf_dir), "interval_id", block_seconds=DAY)
    return table.select(
        "track_id", "interval_id", "idx", to_ms(F.col("prefix_max_end")).alias("prefix_max_end_ms")
    )


@query(
    "q_active",
    f"""WITH {sql.PROBES}
SELECT p.track_id, {sql.ms('p.t')} AS t_ms, i.interval_id
FROM probes p JOIN intervals i ON i.track_id = p.track_id AND i.start <= p.t AND p.t < i."end" """,
)
def q_active(spark, sf_dir):
    table = fixtures.intervals(spark, sf_dir)
    return iv.active_at(table, fixtures.probes(table), 3600.0 * 6).select(
        "track_id", to_ms(F.col("t")).alias("t_ms"), "interval_id"
    )


@query(
    "q_asof",
    f"""WITH {sql.PROBES},
x AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start, "end", interval_id) - 1 AS idx
      FROM intervals)
SELECT p.track_id, {sql.ms('p.t')} AS t_ms, coalesce(x.idx, -1) AS idx, x.interval_id
FROM probes p ASOF LEFT JOIN x ON p.track_id = x.track_id AND p.t >= x.start""",
)
def q_asof(spark, sf_dir):
    table = fixtures.intervals(spark, sf_dir)
    return iv.last_started(table, fixtures.probes(table), "interval_id", DAY).select(
        "track_id", to_ms(F.col("t")).alias("t_ms"), "idx", "interval_id"
    )


@query(
    "q_union",
    f"""WITH {sql.INTERVALS},
m AS (SELECT *, max("end") OVER (PARTITION BY track_id ORDER BY start, "end", interval_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM intervals),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (
        PARTITION BY track_id ORDER BY start, "end", interval_id) AS run FROM m)
SELECT track_id, {sql.ms('min(start)')} AS start_ms, {sql.ms('max("end")')} AS end_ms,
       count(*) AS members
FROM g GROUP BY track_id, run""",
)
def q_union(spark, sf_dir):
    merged = iv.merge_intervals(fixtures.intervals(spark, sf_dir), "interval_id", DAY)
    return merged.select(
        "track_id", to_ms(F.col("start")).alias("start_ms"), to_ms(F.col("end")).alias("end_ms"),
        "members",
    )


@query(
    "q_focus",
    f"""WITH {sql.PROBES},
w AS (
  SELECT track_id, interval_id, start, "end",
         CASE WHEN event_type IN ('error', 'signup') THEN 'adlib' ELSE 'lead' END AS kind,
         CAST(floor(start / 86400e0) AS BIGINT) AS line_no,
         row_number() OVER (PARTITION BY track_id ORDER BY start, "end", interval_id) - 1 AS idx
  FROM intervals),
l0 AS (
  SELECT track_id, line_no, min(start) - 0.03e0 AS start, arg_max("end", idx) + 0.24e0 AS "end",
         arg_min(kind, idx) AS kind
  FROM w GROUP BY track_id, line_no),
l AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start, "end", line_no) - 1 AS idx
      FROM l0),
d AS (SELECT track_id, greatest(0e0, t + 0.055e0) AS t FROM probes),
c AS (
  SELECT d.track_id, d.t, 0 AS rank, w.kind <> 'lead' AS second, w.idx, w.line_no
  FROM d JOIN w ON w.track_id = d.track_id AND w.start <= d.t AND d.t < w."end"
  UNION ALL
  SELECT d.track_id, d.t, 1, l.kind <> 'lead', l.idx, l.line_no
  FROM d JOIN l ON l.track_id = d.track_id AND l.start <= d.t AND d.t < l."end"
  UNION ALL
  SELECT d.track_id, d.t, 2, FALSE, coalesce(l.idx, -1), coalesce(l.line_no, -1)
  FROM d ASOF LEFT JOIN l ON l.track_id = d.track_id AND d.t >= l.start),
r AS (SELECT *, row_number() OVER (PARTITION BY track_id, t ORDER BY rank, second, idx) AS rn FROM c)
SELECT track_id, {sql.ms('t')} AS t_ms, rank AS source, line_no AS focus_line FROM r WHERE rn = 1""",
)
def q_focus(spark, sf_dir):
    table = fixtures.intervals(spark, sf_dir)
    words, lines = fixtures.event_lines(table)
    points = fixtures.probes(table).select(
        "track_id", iv.display_time(F.col("t")).alias("t")
    )
    return iv.focus_line(words, lines, points, 3600.0 * 6, DAY).select(
        "track_id", to_ms(F.col("t")).alias("t_ms"), "source", "focus_line"
    )


# Units of the words of q_fill: begin and end as shares of the word, fill for words of kind 1 and 2, pause before.
_UNITS = ((0.0, 0.3, 0.25, 0.6, False), (0.3, 0.45, 0.6, 0.25, False), (0.8, 0.95, 1.0, 0.9, True))


def _landmark(k, begin, end, first, second, pause):
    """One landmark of the twin: where its sweep begins and ends, what it fills, and the fill at t if t lies in it."""
    sweep = f"greatest(mark{k - 1}, least(begin{k}, mark{k}) - 0.065e0)" if pause else f"mark{k - 1}"
    eased = f"share{k} * share{k} * (3e0 - 2e0 * share{k})" if pause else f"share{k}"
    return f"""a{k} AS (
  SELECT *, start + len * {begin}e0 AS begin{k}, greatest(mark{k - 1} + 0.001e0, least("end", start + len * {end}e0)) AS mark{k},
    greatest(done{k - 1}, CASE kind WHEN 1 THEN {first}e0 ELSE {second}e0 END) AS done{k} FROM m{k - 1}),
b{k} AS (SELECT *, {sweep} AS sweep{k} FROM a{k}),
c{k} AS (SELECT *, greatest(0e0, least(1e0, (t - sweep{k}) / greatest(0.016e0, mark{k} - sweep{k}))) AS share{k} FROM b{k}),
m{k} AS (
  SELECT *, CASE WHEN t <= mark{k} THEN CASE WHEN t <= sweep{k} THEN done{k - 1}
    ELSE done{k - 1} + (done{k} - done{k - 1}) * ({eased}) END END AS fill{k} FROM c{k})"""


_LANDMARKS = ",\n".join(_landmark(k, *unit) for k, unit in enumerate(_UNITS, 1))


@query(
    "q_fill",
    f"""WITH {sql.WORDS},
p AS (
  SELECT w.*, CASE k WHEN 0 THEN start WHEN 1 THEN (start + "end") / 2 ELSE start + ("end" - start) * 0.9e0 END AS t
  FROM words w, (SELECT UNNEST([0, 1, 2]) AS k)),
d AS (SELECT DISTINCT track_id, t FROM p),
m0 AS (
  SELECT w.track_id, w.word_no, w.start, w."end", w."end" - w.start AS len, d.t, w.word_no % 3 AS kind,
    w.start AS mark0, 0e0 AS done0
  FROM words w JOIN d ON d.track_id = w.track_id AND w.start <= d.t AND d.t < w."end"),
{_LANDMARKS}
SELECT track_id, word_no, {sql.ms('t')} AS t_ms,
  CAST(round(CASE WHEN t <= start THEN 0e0 WHEN kind = 0 THEN greatest(0e0, least(1e0, (t - start) / greatest(0.05e0, len)))
       ELSE coalesce(fill1, fill2, fill3, done3) END * 1e6) AS BIGINT) AS fill_ppm
FROM m3""",
)
def q_fill(spark, sf_dir):
    words = stage(fixtures.words(spark, sf_dir), "words")
    kind, length = F.col("word_no") % 3, F.col("end") - F.col("start")
    units = F.array(*[
        F.struct(
            (F.col("start") + length * begin).alias("start"), (F.col("start") + length * end).alias("end"),
            F.when(kind == 1, first).otherwise(second).alias("fill"), F.lit(pause).alias("pause_before"),
        )
        for begin, end, first, second, pause in _UNITS
    ])
    points = words.select(
        "track_id",
        F.explode(
            F.array(
                F.col("start"), (F.col("start") + F.col("end")) / 2,
                F.col("start") + (F.col("end") - F.col("start")) * 0.9,
            )
        ).alias("t"),
    ).distinct()
    filled = iv.fill_at(words.withColumn("timing", F.when(kind > 0, units)), points)
    return filled.select(
        "track_id", "word_no", to_ms(F.col("t")).alias("t_ms"),
        to_ppm(F.col("fill")).alias("fill_ppm"),
    )


_PHRASE_EXTENTS = f"""{sql.WORDS},
norm AS (SELECT *, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_'']+', '', 'g') AS n FROM words),
extents AS (
  SELECT track_id, phrase, min(start) AS start, max("end") AS "end", count(*) AS n_words
  FROM words WHERE kind = 'adlib' GROUP BY track_id, phrase)"""


@query(
    "q_overlap_join",
    f"""WITH {_PHRASE_EXTENTS}
SELECT e.track_id, e.phrase, e.n_words, w.word_no AS lead_word_no
FROM extents e JOIN words w ON w.track_id = e.track_id AND w.kind = 'lead'
 AND w."end" >= e.start - 0.45e0 AND w.start <= e."end" + 0.45e0""",
)
def q_overlap_join(spark, sf_dir):
    from cuesheet.operators.cleaning import phrase_extents

    words = stage(fixtures.words(spark, sf_dir), "words")
    extents = phrase_extents(words.filter(F.col("kind") == "adlib"))
    lead = words.filter(F.col("kind") == "lead").select(
        "track_id", F.col("word_no").alias("lead_word_no"), "start", "end"
    )
    return iv.nearby(extents.select("track_id", "phrase", "start", "end", "n_words"), lead).select(
        "track_id", "phrase", "n_words", "lead_word_no"
    )


KEPT_ADLIBS = f"""{_PHRASE_EXTENTS},
side AS (
  SELECT s.track_id, s.phrase, s.n,
    EXISTS (SELECT 1 FROM norm w WHERE w.track_id = e.track_id AND w.kind = 'lead' AND w.n = s.n
            AND w."end" >= e.start - 0.45e0 AND w.start <= e."end" + 0.45e0) AS leaked
  FROM norm s JOIN extents e ON e.track_id = s.track_id AND e.phrase = s.phrase
  WHERE s.kind = 'adlib' AND s.n <> ''),
ratio AS (
  SELECT track_id, phrase, avg(CASE WHEN leaked THEN 1e0 ELSE 0e0 END) AS r FROM side GROUP BY ALL),
kept AS (
  SELECT e.track_id, e.phrase FROM extents e LEFT JOIN ratio USING (track_id, phrase)
  WHERE e.phrase % 3 = 0 OR (e.n_words <= 6 AND coalesce(r, 1e0) < 0.65e0))"""


@query(
    "q_adlib_filter",
    f"WITH {KEPT_ADLIBS} SELECT track_id, phrase, word_no FROM words JOIN kept USING (track_id, phrase) WHERE kind = 'adlib'",
)
def q_adlib_filter(spark, sf_dir):
    words = stage(fixtures.words(spark, sf_dir), "words").withColumn(
        "source_layer", F.when(F.col("phrase") % 3 == 0, "center").otherwise("side")
    )
    kept = adlib_filter(
        words.filter(F.col("kind") == "adlib"), words.filter(F.col("kind") == "lead")
    )
    return kept.select("track_id", "phrase", "word_no")
