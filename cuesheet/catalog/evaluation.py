"""Queries on transcript comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet import fixtures
from cuesheet.catalog import sql
from cuesheet.catalog.registry import query
from cuesheet.functions.numeric import to_ms
from cuesheet.operators import evaluation as ev
from cuesheet.plans.session import shared_folder, stage
from cuesheet.sources import timings as tm
from cuesheet.sources.files import write_texts


def _tokens(spark, sf_dir):
    reference = stage(fixtures.references(spark, sf_dir), "reference")
    prepared = lambda words: ev.without_adlibs(ev.validated(ev.evaluation_tokens(words)))
    return prepared(reference), prepared(fixtures.candidates(reference))


def micro(name):
    return F.rint(F.col(name) * 1e6).cast("long").alias(f"{name}_micro")


def duck_micro(expression, name):
    return f"CAST(round_even(({expression}) * 1e6, 0) AS BIGINT) AS {name}_micro"


@query(
    "q_wer",
    f"""WITH RECURSIVE {sql.EDIT_PATHS},
c AS (SELECT *, len(path) - len(replace(path, 'M', '')) AS mm, len(path) - len(replace(path, 'S', '')) AS ss,
        len(path) - len(replace(path, 'D', '')) AS dd, len(path) - len(replace(path, 'I', '')) AS ii FROM best)
SELECT track_id, label, CAST(mm AS BIGINT) AS matches, CAST(ss AS BIGINT) AS substitutions,
  CAST(dd AS BIGINT) AS deletions, CAST(ii AS BIGINT) AS insertions,
  {duck_micro('round_even((ss + dd + ii) / n * 1e6, 0) / 1e6', 'wer')} FROM c""",
)
def q_wer(spark, sf_dir):
    return ev.evaluate(*_tokens(spark, sf_dir)).select(
        "track_id", "label", "matches", "substitutions", "deletions", "insertions", micro("wer")
    )


@query(
    "q_alignment",
    f"""WITH RECURSIVE {sql.EDIT_PATHS},
steps AS (
  SELECT track_id, label, UNNEST(range(1, len(path) + 1)) AS k, path FROM best),
p AS (
  SELECT track_id, label, k - 1 AS step_no, substr(path, k, 1) AS op,
    len(replace(replace(substr(path, 1, k), 'I', ''), ' ', '')) AS ri,
    len(replace(substr(path, 1, k), 'D', '')) AS ci FROM steps)
SELECT p.track_id, p.label, CAST(step_no AS BIGINT) AS step_no,
  CASE op WHEN 'M' THEN 'match' WHEN 'S' THEN 'substitution' WHEN 'D' THEN 'deletion' ELSE 'insertion' END
    AS operation,
  CAST(r.pos AS BIGINT) AS ref_pos, CAST(c.pos AS BIGINT) AS cand_pos
FROM p LEFT JOIN refn r ON op <> 'I' AND r.track_id = p.track_id AND r.no = ri
LEFT JOIN candn c ON op <> 'D' AND c.track_id = p.track_id AND c.label = p.label AND c.no = ci""",
)
def q_alignment(spark, sf_dir):
    return ev.align(*_tokens(spark, sf_dir)).select(
        "track_id", "label", F.col("step_no").cast("long").alias("step_no"), "operation",
        "ref_pos", "cand_pos",
    )


def _duck_metrics(group):
    """Timing metrics of matched deltas, in whole nanoseconds."""
    return f"""
u AS (SELECT track_id, label, UNNEST(onsets) AS a, UNNEST(offsets) AS b FROM best),
z AS (SELECT {group}, sum(n) AS n_words FROM best GROUP BY {group})
SELECT {group}, count(*) AS matched_words,
  {duck_micro('avg(a)', 'onset_bias')}, {duck_micro('avg(abs(a))', 'onset_mae')},
  {duck_micro('quantile_cont(abs(a), 0.5)', 'onset_median')},
  {duck_micro('quantile_cont(abs(a), 0.9)', 'onset_p90')},
  {duck_micro('avg(b)', 'offset_bias')}, {duck_micro('avg(abs(b))', 'offset_mae')},
  {duck_micro('quantile_cont(abs(b), 0.5)', 'offset_median')},
  {duck_micro('quantile_cont(abs(b), 0.9)', 'offset_p90')},
  {duck_micro('count(*) / any_value(n_words)', 'reference_coverage')},
  {duck_micro('avg(abs(b - a))', 'duration_mae')},
  {duck_micro('avg(CASE WHEN abs(a) <= 0.05e0 THEN 1e0 ELSE 0e0 END)', 'onset_within_50ms')},
  {duck_micro('avg(CASE WHEN abs(a) <= 0.1e0 THEN 1e0 ELSE 0e0 END)', 'onset_within_100ms')},
  {duck_micro('avg(CASE WHEN abs(a) <= 0.25e0 THEN 1e0 ELSE 0e0 END)', 'onset_within_250ms')}
FROM u JOIN z USING ({group}) GROUP BY {group}"""


def _metrics(df, *keys):
    second = lambda name: F.rint(F.col(f"{name}_ms") * 1e3).cast("long").alias(f"{name}_micro")
    return df.select(
        *keys, "matched_words", second("onset_bias"), second("onset_mae"), second("onset_median"),
        second("onset_p90"), second("offset_bias"), second("offset_mae"), second("offset_median"),
        second("offset_p90"), second("duration_mae"), micro("reference_coverage"), micro("onset_within_50ms"),
        micro("onset_within_100ms"), micro("onset_within_250ms"),
    )


@query("q_timing", f"WITH RECURSIVE {sql.EDIT_PATHS}, {_duck_metrics('track_id, label')}")
def q_timing(spark, sf_dir):
    return _metrics(ev.evaluate(*_tokens(spark, sf_dir)), "track_id", "label")


@query("q_leaderboard", f"WITH RECURSIVE {sql.EDIT_PATHS}, {_duck_metrics('label')}")
def q_leaderboard(spark, sf_dir):
    pairs = ev.character_distance(ev.sequence_pairs(*_tokens(spark, sf_dir)))
    stored = stage(ev.aligned_pairs(pairs), "aligned")
    steps = stored.select("track_id", "label", F.inline("steps"))
    return _metrics(ev.leaderboard(steps, stored), "label")


def _one_byte(text):
    """The twin's distance counts bytes: normalized text has no capitals, so each accented letter becomes one."""
    return f"translate({text}, 'àáâãäæçèéêëìíîïñòóôõöøùúûü', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query(
    "q_cer",
    f"""WITH {sql.EVAL_TOKENS},
r AS (SELECT track_id, {_one_byte("string_agg(norm, ' ' ORDER BY pos)")} AS t, length(string_agg(norm, ' ' ORDER BY pos)) AS n
      FROM ref WHERE norm <> '' GROUP BY track_id),
c AS (SELECT track_id, label, {_one_byte("string_agg(norm, ' ' ORDER BY pos)")} AS t FROM cand WHERE norm <> '' GROUP BY ALL)
SELECT track_id, label, CAST(levenshtein(r.t, c.t) AS BIGINT) AS character_errors,
       CAST(n AS BIGINT) AS reference_characters
FROM r JOIN c USING (track_id)""",
)
def q_cer(spark, sf_dir):
    pairs = ev.sequence_pairs(*_tokens(spark, sf_dir))
    return ev.character_distance(pairs).select(
        "track_id", "label", F.col("character_errors").cast("long").alias("character_errors"),
        F.col("reference_characters").cast("long").alias("reference_characters"),
    )


def _documents(spark, sf_dir):
    """Candidates as JSON documents: word arrays, and lines with a sung ad-lib."""
    words = fixtures.candidates(stage(fixtures.references(spark, sf_dir), "reference"))
    item = F.struct("pos", "text", "start", "end")
    grouped = words.groupBy("track_id", "label").agg(
        F.array_sort(F.collect_list(item)).alias("w")
    ).withColumn("w", F.transform("w", lambda w: w.dropFields("pos")))
    adlib = F.struct(F.lit("adlib").alias("kind"), F.array(F.lit("yeah")).alias("words"))
    as_lines = F.concat(
        F.lit('{"lines":['),
        F.to_json(F.struct(F.lit("lead").alias("kind"), F.col("w").alias("words"))),
        F.lit(","), F.to_json(adlib), F.lit("]}"),
    )
    as_words = F.to_json(F.struct(F.col("w").alias("words")))
    value = F.when(F.col("label") == "first", as_words).when(
        F.col("track_id") % 5 == 4, F.lit('{"title": "no words here"}')
    ).otherwise(as_lines)
    return grouped.select("label", "track_id", value.alias("value"))


@query(
    "q_read_json",
    f"""WITH {sql.EVAL_TOKENS}
SELECT label, track_id, norm AS normalized, {sql.ms('start')} AS start_ms, {sql.ms('"end"')} AS end_ms, 'lead' AS kind
FROM cand WHERE norm <> '' AND (label = 'first' OR track_id % 5 <> 4)""",
)
def q_read_json(spark, sf_dir):
    folder = shared_folder(spark, "documents")
    write_texts(_documents(spark, sf_dir), folder, ["label", "track_id"])
    tokens, _ = tm.read_timings(spark, folder)
    return tokens.select(
        "label", F.col("track_id").cast("long").alias("track_id"), "normalized",
        to_ms(F.col("start")).alias("start_ms"), to_ms(F.col("end")).alias("end_ms"), "kind",
    )


@query(
    "q_report",
    f"""WITH RECURSIVE {sql.EDIT_PATHS},
c AS (SELECT *, len(path) - len(replace(path, 'M', '')) AS mm, len(path) - len(replace(path, 'S', '')) AS ss,
        len(path) - len(replace(path, 'D', '')) AS dd, len(path) - len(replace(path, 'I', '')) AS ii FROM best)
SELECT track_id, label, label || chr(10) || printf('  WER: %.2f%%', (ss + dd + ii) / n * 100) AS head,
  '  S/D/I: ' || ss || '/' || dd || '/' || ii AS counts,
  printf('  Onset bias: %.1f ms', round(list_avg(onsets) * 1e3, 3)) AS bias
FROM c""",
)
def q_report(spark, sf_dir):
    report = tm.report_text(ev.evaluate(*_tokens(spark, sf_dir)))
    lines = F.split("value", "\n")
    return report.select(
        "track_id", "label", F.concat_ws("\n", F.get(lines, F.lit(0)), F.get(lines, F.lit(1))).alias("head"),
        F.get(lines, F.lit(3)).alias("counts"), F.get(lines, F.lit(6)).alias("bias"),
    )


@query(
    "q_report_json",
    f"""WITH RECURSIVE {sql.EDIT_PATHS},
c AS (SELECT *, len(path) - len(replace(path, 'S', '')) AS ss, len(path) - len(replace(path, 'D', '')) AS dd,
        len(path) - len(replace(path, 'I', '')) AS ii FROM best)
SELECT track_id, label, label AS named, CAST(ss AS BIGINT) AS substitutions, CAST(dd AS BIGINT) AS deletions,
  CAST(ii AS BIGINT) AS insertions, {duck_micro('round_even((ss + dd + ii) / n * 1e6, 0) / 1e6', 'wer')},
  {duck_micro('round(list_avg(onsets) * 1e3, 3)', 'onset_bias_ms')}
FROM c""",
)
def q_report_json(spark, sf_dir):
    """Written as JSON report files, read back from them."""
    folder = shared_folder(spark, "reports")
    tm.write_report(ev.evaluate(*_tokens(spark, sf_dir)), folder, "json")
    read = spark.read.schema("value string, track_id long").text(folder)
    at = lambda path, kind: F.get_json_object("value", f"$.{path}").cast(kind)
    return read.select(
        "track_id", F.regexp_extract("value", '"label":"([^"]*)"', 1).alias("label"), at("label", "string").alias("named"),
        *[at(f"metrics.{c}", "long").alias(c) for c in ("substitutions", "deletions", "insertions")],
        F.rint(at("metrics.wer", "double") * 1e6).cast("long").alias("wer_micro"),
        F.rint(at("metrics.timing.onset_bias_ms", "double") * 1e6).cast("long").alias("onset_bias_ms_micro"),
    )


@query(
    "q_token_problems",
    """WITH t AS (
  SELECT event_id, user_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' || event_type || ' ' WHEN 2 THEN ' - ' ELSE event_type END AS text,
    CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN -1e0 WHEN 2 THEN 'nan'::DOUBLE ELSE event_id % 50 END AS s,
    CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'inf'::DOUBLE ELSE event_id % 30 END AS e
  FROM events),
p AS (
  SELECT event_id, user_id, trim(text) AS text, CASE
    WHEN isnan(s) OR s < 0 THEN 'invalid start' WHEN isinf(e) THEN 'invalid end'
    WHEN (s IS NULL) <> (e IS NULL) THEN 'only one timestamp' WHEN e < s THEN 'ends before it starts' END AS problem
  FROM t WHERE text IS NOT NULL AND text <> ' - ')
SELECT event_id, user_id AS track_id, text, problem, problem IS NULL AS stays FROM p""",
)
def q_token_problems(spark, sf_dir):
    """What makes a token unusable, and which tokens a lenient run keeps."""
    n, number = F.col("event_id"), lambda x: F.lit(float(x))
    tokens = ev.evaluation_tokens(fixtures.table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("track_id"),
        F.when(n % 6 == 1, F.concat(F.lit("  "), "event_type", F.lit(" "))).when(n % 6 == 2, " - ")
        .when(n % 6 > 2, F.col("event_type")).alias("text"),
        F.when(n % 7 == 1, number(-1)).when(n % 7 == 2, number("nan")).when(n % 7 > 2, (n % 50).cast("double")).alias("start"),
        F.when(n % 5 == 1, number("inf")).when(n % 5 > 1, (n % 30).cast("double")).alias("end"),
    ))
    usable = ev.validated(tokens, strict=False).select("event_id", F.lit(True).alias("_usable"))
    return tokens.join(usable, "event_id", "left").select(
        "event_id", "track_id", "text", "problem", F.coalesce("_usable", F.lit(False)).alias("stays"))
