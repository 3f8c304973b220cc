"""Queries on token spans, confidence, routing and placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet import fixtures
from cuesheet.catalog import sql
from cuesheet.catalog.registry import query
from cuesheet.constants import ALIGNER_LANGUAGES
from cuesheet.functions.numeric import to_ms
from cuesheet.functions.spoken import spoken_form
from cuesheet.operators import alignment as al
from cuesheet.plans.session import stage

FRAME_SECONDS = 0.05
R = sql.rounded


def micro(name):
    return F.rint(F.col(name) * 1e6).cast("long").alias(f"{name}_micro")


def duck_micro(expression, name):
    return f"CAST(round_even(({expression}) * 1e6, 0) AS BIGINT) AS {name}_micro"


_REFINED = """
em AS (
  SELECT vec_id AS segment_id, (p - 1) // 8 AS frame, (p - 1) % 8 AS token_id, -abs(CAST(v AS DOUBLE)) * 10 AS logp
  FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS p, UNNEST(embedding) AS v FROM embeddings)),
spans AS (
  SELECT segment_id, t AS token_no, 1 + (t * 3 + segment_id) % 7 AS token_id, t AS f0, t + 3 AS f1,
         CASE WHEN t <> 2 THEN t // 2 END AS owner_word
  FROM (SELECT DISTINCT vec_id AS segment_id FROM embeddings), (SELECT UNNEST(range(0, 6)) AS t)),
scored AS (
  SELECT s.segment_id, s.token_no, s.owner_word, e.frame, e.logp, b.logp AS blank
  FROM spans s JOIN em e ON e.segment_id = s.segment_id AND e.token_id = s.token_id AND e.frame >= f0 AND e.frame < f1
  JOIN em b ON b.segment_id = s.segment_id AND b.frame = e.frame AND b.token_id = 0),
refined AS (
  SELECT segment_id, token_no, any_value(owner_word) AS owner_word,
    coalesce(min(frame) FILTER (logp >= blank), arg_max(frame, struct_pack(l := logp, f := -frame))) AS sf,
    coalesce(max(frame) FILTER (logp >= blank), arg_max(frame, struct_pack(l := logp, f := -frame))) + 1 AS ef,
    max(logp) AS best
  FROM scored GROUP BY segment_id, token_no),
owned AS (SELECT * FROM refined WHERE owner_word IS NOT NULL),
word0 AS (
  SELECT segment_id, owner_word, arg_min(sf, token_no) * 0.05e0 AS s, arg_max(ef, token_no) * 0.05e0 AS e,
         exp(avg(best)) AS c, count(*) AS n_tokens
  FROM owned GROUP BY ALL)"""


@query(
    "q_confidence",
    f"""WITH {_REFINED}
SELECT segment_id, CAST(owner_word AS BIGINT) AS owner_word, {sql.ms(R('s'))} AS start_ms,
       {sql.ms(R('e'))} AS end_ms, {duck_micro(R('c', 4), 'confidence')}, n_tokens FROM word0""",
)
def q_confidence(spark, sf_dir):
    emissions = fixtures.emissions(spark, sf_dir)
    refined = al.refined_spans(fixtures.token_spans(spark, sf_dir), emissions, 0)
    return al.word_roll_up(refined, F.lit(FRAME_SECONDS)).select(
        "segment_id", "owner_word", to_ms(F.col("start")).alias("start_ms"),
        to_ms(F.col("end")).alias("end_ms"), micro("confidence"), "n_tokens",
    )


@query(
    "q_units",
    f"""WITH {_REFINED},
u AS (
  SELECT segment_id, owner_word, row_number() OVER w AS unit_no, count(*) OVER (PARTITION BY segment_id, owner_word) AS n,
    lag(ef) OVER w * 0.05e0 AS gap_start, sf * 0.05e0 AS s, greatest(sf + 1, ef) * 0.05e0 AS e
  FROM owned WINDOW w AS (PARTITION BY segment_id, owner_word ORDER BY token_no)),
f AS (SELECT *, unit_no / n AS fill FROM u)
SELECT segment_id, CAST(owner_word AS BIGINT) AS owner_word, unit_no, {sql.ms(R('s'))} AS start_ms,
  {sql.ms(R('e'))} AS end_ms, {duck_micro(R('fill', 4), 'fill')}, {sql.ms('gap_start')} AS gap_start_ms FROM f""",
)
def q_units(spark, sf_dir):
    refined = al.refined_spans(
        fixtures.token_spans(spark, sf_dir), fixtures.emissions(spark, sf_dir), 0
    )
    return al.timing_units(refined, F.lit(FRAME_SECONDS)).select(
        "segment_id", "owner_word", F.col("unit_no").cast("long").alias("unit_no"),
        to_ms(F.col("start")).alias("start_ms"), to_ms(F.col("end")).alias("end_ms"),
        micro("fill"), to_ms(F.col("gap_start")).alias("gap_start_ms"),
    )


_SCORES = f"""{_REFINED},
words_of AS (
  SELECT segment_id, owner_word, {R('c', 4)} AS c, 3 + (segment_id + owner_word) % 5 AS len FROM word0),
raw_of AS (
  SELECT segment_id, w AS owner_word, CASE WHEN w = 4 THEN 0 ELSE 3 + (segment_id + w) % 5 END AS len
  FROM (SELECT DISTINCT segment_id FROM em), (SELECT UNNEST(range(0, 5)) AS w)),
score AS (
  SELECT r.segment_id, coalesce(a.conf, 0e0) AS confidence, least(1e0, coalesce(a.covered, 0) / r.expected) AS coverage
  FROM (SELECT segment_id, sum(len) AS expected FROM raw_of WHERE len > 0 GROUP BY ALL) r
  LEFT JOIN (SELECT segment_id, sum(len) AS covered, sum(len * c) / sum(len) AS conf
             FROM words_of WHERE owner_word <> segment_id % 9 GROUP BY ALL) a USING (segment_id))"""


def _scores(spark, sf_dir):
    emissions = fixtures.emissions(spark, sf_dir)
    words = al.word_roll_up(
        al.refined_spans(fixtures.token_spans(spark, sf_dir), emissions, 0), F.lit(FRAME_SECONDS)
    )
    length = lambda w: 3 + (F.col("segment_id") + F.col(w)) % 5
    aligned = words.filter(F.col("owner_word") != F.col("segment_id") % 9).withColumn(
        "spoken_length", length("owner_word")
    )
    raw = emissions.select("segment_id").distinct().select(
        "segment_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("w")
    ).withColumn("spoken_length", F.when(F.col("w") == 4, 0).otherwise(length("w")))
    return al.segment_scores(aligned, raw)


@query(
    "q_coverage",
    f"""WITH {_SCORES}
SELECT segment_id, CAST(round_even(confidence * 1e9, 0) AS BIGINT) AS confidence_nano,
  {duck_micro('coverage', 'coverage')} FROM score""",
)
def q_coverage(spark, sf_dir):
    nano = F.rint(F.col("confidence") * 1e9).cast("long").alias("confidence_nano")
    return _scores(spark, sf_dir).select("segment_id", nano, micro("coverage"))


@query(
    "q_gate",
    f"""WITH {_SCORES},
g AS (SELECT *, segment_id % 3 = 0 AS side, segment_id % 11 = 0 AS invented FROM score)
SELECT segment_id, CASE
  WHEN confidence >= CASE WHEN side THEN 0.17e0 ELSE 0.1e0 END AND coverage >= 0.8e0 AND NOT invented THEN 'aligned'
  WHEN invented OR side THEN 'drop' ELSE 'raw' END AS decision FROM g""",
)
def q_gate(spark, sf_dir):
    text = F.when(F.col("segment_id") % 11 == 0, "Thanks for watching!").otherwise("la la")
    layer = F.when(F.col("segment_id") % 3 == 0, "side").otherwise("center")
    return _scores(spark, sf_dir).select(
        "segment_id", al.acceptance(F.col("confidence"), F.col("coverage"), layer, text).alias("decision")
    )


_KNOWN = ", ".join(
    f"('{a}', '{name}')" for name, spellings in ALIGNER_LANGUAGES.items() for a in spellings
)


_ROUTES = f"""known(k, aligner_language) AS (VALUES {_KNOWN}),
s AS (
  SELECT doc_id, ['none', 'ctc', 'qwen3'][1 + doc_id % 3] AS backend,
    ['auto', 'English', 'ES', 'korean', 'Auto-Detect'][1 + doc_id % 5] AS requested, lang AS detected,
    CASE WHEN doc_id % 4 = 0 THEN 'side' ELSE 'center' END AS layer, doc_id % 7 < 4 AS ok,
    doc_id % 6 <> 0 AS has_path, doc_id % 4 = 0 AND doc_id % 5 < 2 AS broken, (doc_id % 30) / 1e2 AS confidence, 0.7e0 + (doc_id % 10) / 30e0 AS coverage
  FROM documents),
k AS (
  SELECT s.*, known.aligner_language, regexp_replace(lower(requested), '[^a-z]+', '', 'g') AS rq,
    regexp_replace(lower(detected), '[^a-z]+', '', 'g') AS dt
  FROM s LEFT JOIN known ON k = CASE WHEN replace(lower(requested), '-', '') IN ('', 'auto', 'autodetect')
    THEN replace(lower(detected), '-', '') ELSE replace(lower(requested), '-', '') END),
f AS (
  SELECT *, rq IN ('en', 'eng', 'english') OR (rq IN ('', 'auto', 'autodetect') AND dt IN ('en', 'eng', 'english')) AS english,
    backend = 'qwen3' AND aligner_language IS NOT NULL AS multi FROM k),
d AS (
  SELECT *, CASE
    WHEN NOT (multi OR (backend <> 'none' AND english)) THEN 'raw'
    WHEN multi AND ok THEN 'multilingual'
    WHEN backend = 'qwen3' AND layer = 'side' THEN 'drop'
    WHEN backend = 'qwen3' AND NOT english THEN 'raw'
    WHEN broken THEN 'raw'
    WHEN NOT has_path THEN CASE layer WHEN 'side' THEN 'drop' ELSE 'raw' END
    WHEN confidence >= CASE layer WHEN 'side' THEN 0.17e0 ELSE 0.1e0 END AND coverage >= 0.8e0 THEN 'aligned'
    WHEN layer = 'side' THEN 'drop' ELSE 'raw' END AS route,
   CASE
    WHEN NOT (multi OR (backend <> 'none' AND english)) THEN 1e0
    WHEN multi AND ok THEN 1e0
    WHEN backend = 'qwen3' AND (layer = 'side' OR NOT english) THEN 0e0
    WHEN broken OR NOT has_path THEN 0e0 ELSE confidence END AS segment_confidence FROM f)"""


def _routes(spark, sf_dir):
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % n).cast("int"))
    segments = fixtures.table(spark, sf_dir, "documents").select(
        "doc_id", pick(["none", "ctc", "qwen3"], 3).alias("backend"),
        pick(["auto", "English", "ES", "korean", "Auto-Detect"], 5).alias("requested_language"),
        F.col("lang").alias("detected_language"),
        F.when(F.col("doc_id") % 4 == 0, "side").otherwise("center").alias("source_layer"),
        (F.col("doc_id") % 7 < 4).alias("multilingual_ok"), (F.col("doc_id") % 6 != 0).alias("has_path"),
        ((F.col("doc_id") % 4 == 0) & (F.col("doc_id") % 5 < 2)).alias("path_error"),
        ((F.col("doc_id") % 30) / 100.0).alias("confidence"),
        (F.lit(0.7) + (F.col("doc_id") % 10) / 30.0).alias("coverage"),
        F.lit("la la").alias("aligned_text"),
    )
    return al.route_alignment(al.aligner_language(spark, segments))


@query(
    "q_route",
    f"""WITH {_ROUTES}
SELECT doc_id, aligner_language, route, {duck_micro('segment_confidence', 'segment_confidence')} FROM d""",
)
def q_route(spark, sf_dir):
    return _routes(spark, sf_dir).select(
        "doc_id", "aligner_language", "route", micro("segment_confidence")
    )


@query(
    "q_routed_words",
    f"""WITH {_ROUTES},
w AS (SELECT doc_id, string_split(text, ' ') AS pieces FROM documents),
r AS (
  SELECT doc_id, route, segment_confidence, list_transform(pieces, lambda p: CASE route
    WHEN 'raw' THEN p WHEN 'aligned' THEN 'a' || p ELSE 'm' || p END) AS pieces
  FROM d JOIN w USING (doc_id) WHERE route <> 'drop' AND pieces IS NOT NULL)
SELECT doc_id AS segment_id, {duck_micro('segment_confidence', 'segment_confidence')}, len(pieces) AS n_words,
  md5(array_to_string(pieces, ' ')) AS words_md5
FROM r""",
)
def q_routed_words(spark, sf_dir):
    """Words of the branch that each document's segment takes; dropped segments have none."""
    routes = stage(_routes(spark, sf_dir).withColumnRenamed("doc_id", "segment_id"), "routes")
    raw = fixtures.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("segment_id"), F.posexplode(F.split("text", " ")).alias("pos", "text"))
    words = al.routed_words(
        routes, raw, *[raw.withColumn("text", F.concat(F.lit(mark), "text")) for mark in ("a", "m")])
    rows = words.groupBy("segment_id").agg(
        F.first("segment_confidence").alias("segment_confidence"), F.count(F.lit(1)).alias("n_words"),
        F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_words"))
    return rows.select(
        "segment_id", micro("segment_confidence"), "n_words",
        F.md5(F.array_join(F.transform("_words", lambda w: w["text"]), " ")).alias("words_md5"))


@query(
    "q_segments",
    f"""WITH {sql.PHRASES},
c AS (
  SELECT track_id, phrase, len(piece_list) * 0.35e0 AS dur,
    CASE WHEN phrase % 3 = 0 THEN NULL ELSE phrase * 0.25e0 - 0.5e0 END AS cs,
    CASE WHEN phrase % 4 = 0 THEN NULL ELSE len(piece_list) * 0.4e0 - phrase END AS ce FROM phrases),
b AS (SELECT *, greatest(0e0, least(dur, coalesce(cs, 0e0))) AS s FROM c),
e AS (SELECT *, greatest(s + 0.04e0, least(dur, coalesce(ce, dur))) AS e FROM b),
x AS (SELECT *, greatest(0e0, s - 0.3e0) AS xs, least(dur, e + 0.3e0) AS xe FROM e),
p AS (SELECT *, CAST(trunc(xs * 16000) AS BIGINT) AS first_sample FROM x)
SELECT track_id, phrase, {sql.ms('s')} AS start_ms, {sql.ms('e')} AS end_ms, first_sample,
  greatest(first_sample + 1, CAST(trunc(xe * 16000) AS BIGINT)) AS last_sample,
  {sql.ms('s - xs')} AS local_ms, {sql.ms('greatest(0.04e0, e - s)')} AS spoken_ms FROM p""",
)
def q_segments(spark, sf_dir):
    chunks = fixtures.phrases(spark, sf_dir).select(
        "track_id", "phrase", F.col("phrase_seconds").alias("chunk_seconds"),
        F.when(F.col("phrase") % 3 != 0, F.col("phrase") * 0.25 - 0.5).alias("chunk_start"),
        F.when(F.col("phrase") % 4 != 0, F.size("piece_list") * 0.4 - F.col("phrase")).alias("chunk_end"),
    )
    return al.segment_bounds(chunks).select(
        "track_id", "phrase", to_ms(F.col("segment_start")).alias("start_ms"),
        to_ms(F.col("segment_end")).alias("end_ms"), "first_sample", "last_sample",
        to_ms(F.col("local_start")).alias("local_ms"), to_ms(F.col("spoken_seconds")).alias("spoken_ms"),
    )


@query(
    "q_place",
    f"""WITH {sql.BEATS},
w AS (SELECT *, (phrase + 40) * 1.37e0 AS base, ("end" - start) * 1.5e0 AS len FROM beats),
a AS (SELECT *, base + start AS ws, base + (start + len) AS we FROM w),
k AS (SELECT *, greatest(0e0, ws) AS s0, greatest(ws + 0.04e0, we) AS e0, base + (start + len / 3) AS us,
        greatest(base + (start + len / 3) + 0.008e0, base + (start + len / 2)) AS ue
      FROM a WHERE we - ws <= 4)
SELECT track_id, word_no, {sql.ms(R('s0'))} AS start_ms, {sql.ms(R('e0'))} AS end_ms,
  {sql.ms(R('us'))} AS unit_start_ms, {sql.ms(R('ue'))} AS unit_end_ms FROM k""",
)
def q_place(spark, sf_dir):
    length = (F.col("end") - F.col("start")) * 1.5
    words = stage(fixtures.beats(spark, sf_dir), "beats").withColumn("_len", length).select(
        "track_id", "word_no", "text", "start", (F.col("start") + F.col("_len")).alias("end"),
        ((F.col("phrase") + 40) * 1.37).alias("segment_time"),
        F.array(
            F.struct(
                (F.col("start") + F.col("_len") / 3).alias("start"),
                (F.col("start") + F.col("_len") / 2).alias("end"),
                F.lit(1.0).alias("fill"), F.lit(False).alias("pause_before"),
            )
        ).alias("timing"),
    )
    unit = F.get("timing", F.lit(0))
    return al.place_words(words).select(
        "track_id", "word_no", to_ms(F.col("start")).alias("start_ms"), to_ms(F.col("end")).alias("end_ms"),
        to_ms(unit["start"]).alias("unit_start_ms"), to_ms(unit["end"]).alias("unit_end_ms"),
    )


@query(
    "q_map_timestamps",
    f"""WITH {sql.EVAL_TOKENS},
raw AS (SELECT track_id, pos, text FROM reference),
items AS (
  SELECT track_id, pos, CASE WHEN track_id % 3 = 2 AND pos = 1 THEN 'other' ELSE text END AS text, start,
    CASE WHEN pos % 10 = 9 THEN start ELSE "end" END AS "end"
  FROM reference r
  WHERE track_id % 3 = 0 OR pos < (SELECT max(pos) FROM reference q WHERE q.track_id = r.track_id)),
n AS (SELECT track_id, count(*) AS n FROM raw GROUP BY ALL),
m AS (SELECT track_id, count(*) AS n FROM items GROUP BY ALL),
mapped AS (
  SELECT i.track_id, i.pos, n.n = m.n AS exact, CASE WHEN n.n = m.n THEN raw.text ELSE i.text END AS text, i.start, i."end"
  FROM items i JOIN n USING (track_id) JOIN m USING (track_id)
  LEFT JOIN raw ON raw.track_id = i.track_id AND raw.pos = i.pos WHERE i."end" > i.start),
t AS (
  SELECT track_id, regexp_replace(replace(lower(string_agg(text, '' ORDER BY pos)), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS b
  FROM mapped WHERE NOT exact GROUP BY ALL),
a AS (
  SELECT track_id, regexp_replace(replace(lower(string_agg(text, '' ORDER BY pos)), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS a
  FROM raw GROUP BY ALL),
bad AS (SELECT track_id FROM t JOIN a USING (track_id) WHERE NOT contains(a, b) AND NOT contains(b, a))
SELECT track_id, pos, text, {sql.ms('start')} AS start_ms, {sql.ms('"end"')} AS end_ms
FROM mapped WHERE track_id NOT IN (SELECT track_id FROM bad)""",
)
def q_map_timestamps(spark, sf_dir):
    words = stage(fixtures.references(spark, sf_dir), "reference").withColumn("phrase", F.lit(0))
    last = words.groupBy("track_id").agg(F.max("pos").alias("last"))
    shift = F.col("track_id") % 3
    items = words.join(last, "track_id").filter((shift == 0) | (F.col("pos") < F.col("last"))).select(
        "track_id", "phrase", "pos",
        F.when((shift == 2) & (F.col("pos") == 1), "other").otherwise(F.col("text")).alias("text"),
        F.col("start").alias("start_time"),
        F.when(F.col("pos") % 10 == 9, F.col("start")).otherwise(F.col("end")).alias("end_time"),
    )
    return al.map_timestamps(words, items).select(
        "track_id", "pos", "text", to_ms(F.col("start")).alias("start_ms"),
        to_ms(F.col("end")).alias("end_ms"),
    )


# The number words of the twin, stated apart from those of the library.
_SMALL = ["", "ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE", "TEN", "ELEVEN", "TWELVE", "THIRTEEN",
          "FOURTEEN", "FIFTEEN", "SIXTEEN", "SEVENTEEN", "EIGHTEEN", "NINETEEN"]
_TENS = ["TWENTY", "THIRTY", "FORTY", "FIFTY", "SIXTY", "SEVENTY", "EIGHTY", "NINETY"]
_LINE_ORDINALS = ["FIRST", "SECOND", "THIRD", "FOURTH", "FIFTH", "SIXTH", "SEVENTH"]


def _duck_number(n):
    return (
        f"(CASE WHEN {n} = 0 THEN 'ZERO' ELSE "
        f"CASE WHEN {n} >= 1000000 THEN card[1 + {n} // 1000000] || 'MILLION' ELSE '' END || "
        f"CASE WHEN {n} // 1000 % 1000 > 0 THEN card[1 + {n} // 1000 % 1000] || 'THOUSAND' ELSE '' END || "
        f"CASE WHEN {n} % 1000 > 0 THEN card[1 + {n} % 1000] ELSE '' END END)"
    )


@query(
    "q_spoken",
    f"""WITH names AS (SELECT {_SMALL} AS small, {_TENS} AS tens, {_LINE_ORDINALS} AS ord),
dims AS (
  SELECT list(CASE WHEN i = 0 THEN 'ZERO' ELSE CASE WHEN i >= 100 THEN small[1 + i // 100] || 'HUNDRED' ELSE '' END
    || CASE WHEN i % 100 >= 20 THEN tens[i % 100 // 10 - 1] || small[1 + i % 10] ELSE small[1 + i % 100] END END ORDER BY i) AS card,
    any_value(ord) AS ord
  FROM range(1000) r(i), names),
n AS (
  SELECT DISTINCT l_orderkey AS k, l_linenumber AS no, CAST(l_quantity AS BIGINT) AS q, l_extendedprice AS price,
    CAST(floor(l_extendedprice) AS BIGINT) AS whole, split_part(CAST(l_extendedprice AS VARCHAR), '.', 2) AS cents
  FROM lineitem)
SELECT k, no, q, CAST(round_even(price * 100, 0) AS BIGINT) AS price_cents,
  {_duck_number('k')} || {_duck_number('q')} || 'PERCENT' || ord[no] || 'FOR' || {_duck_number('whole')} || 'POINT'
  || array_to_string(list_transform(string_split(cents, ''), lambda d: card[1 + CAST(d AS INT)]), '') || 'DOLLARS' AS spoken
FROM n, dims""",
)
def q_spoken(spark, sf_dir):
    suffix = F.when(F.col("no") == 1, "st").when(F.col("no") == 2, "nd").when(F.col("no") == 3, "rd").otherwise("th")
    distinct = fixtures.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("no"),
        F.col("l_quantity").cast("long").alias("q"), F.col("l_extendedprice").alias("price"),
    ).distinct()
    # every third key in Arabic-Indic digits, every second price after a no-break space
    key = F.col("k").cast("string")
    text = F.concat_ws(
        " ", F.when(F.col("k") % 3 == 0, F.translate(key, "0123456789", "٠١٢٣٤٥٦٧٨٩")).otherwise(key),
        F.concat("q", F.lit("%")), F.concat(F.col("no"), suffix), F.lit("for"),
        F.concat(F.lit("$"), F.when(F.col("k") % 2 == 0, "\u00a0").otherwise(""), F.col("price").cast("string")),
    )
    return distinct.withColumn("text", text).select(
        "k", "no", "q", F.rint(F.col("price") * 100).cast("long").alias("price_cents"),
        spoken_form(F.col("text")).alias("spoken"),
    )
