"""Queries on words, phrases and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet import fixtures
from cuesheet.catalog import sql
from cuesheet.catalog.registry import query
from cuesheet.functions.numeric import to_ms
from cuesheet.functions import text as tx
from cuesheet.operators import lines as ln, phrases as ph
from cuesheet.plans.session import stage


def line_rows(spark, sf_dir, offsets=False):
    """Numbered lines of all conversations; words and lines are stored in between."""
    words = stage(fixtures.words(spark, sf_dir), "words")
    return ln.number_lines(stage(ln.group_lines(words), "lines"), offsets=offsets)


@query(
    "q_lines",
    f"""WITH RECURSIVE {sql.LINE_STEPS}
SELECT track_id, line_no, 'line-' || line_no || '-' || kind || '-' || start AS line_id,
       {sql.ms('start')} AS start_ms, {sql.ms('"end"')} AS end_ms, kind, n_words,
       line_text
FROM lines""",
)
def q_lines(spark, sf_dir):
    return line_rows(spark, sf_dir).select(
        "track_id", "line_no", "line_id", to_ms(F.col("start")).alias("start_ms"),
        to_ms(F.col("end")).alias("end_ms"), "kind",
        F.size("words").cast("long").alias("n_words"),
        F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("line_text"),
    )


@query(
    "q_line_flags",
    f"""WITH {sql.WORDS},
flagged AS (
  SELECT *, lag("end") OVER w AS pe, lag(phrase) OVER w AS pp, lag(text) OVER w AS pt
  FROM words WINDOW w AS (PARTITION BY track_id, kind ORDER BY start, "end", word_no))
SELECT track_id, kind, count(*) AS n_words,
       CAST(count(*) FILTER (phrase <> pp) AS BIGINT) AS phrase_changes,
       CAST(count(*) FILTER (regexp_matches(pt, '[.!?…]$')) AS BIGINT) AS after_sentence,
       CAST(sum({sql.ms('start - pe')}) AS BIGINT) AS gap_ms
FROM flagged GROUP BY track_id, kind""",
)
def q_line_flags(spark, sf_dir):
    flagged = ln.line_flags(stage(fixtures.words(spark, sf_dir), "words"))
    return flagged.groupBy("track_id", "kind").agg(
        F.count(F.lit(1)).alias("n_words"),
        F.count_if("phrase_changed").alias("phrase_changes"),
        F.count_if("after_sentence").alias("after_sentence"),
        F.sum(to_ms(F.col("gap"))).alias("gap_ms"),
    )


@query(
    "q_tokenize",
    f"""WITH p AS (SELECT doc_id, {sql.pieces('text')} AS pl FROM documents)
SELECT doc_id, CAST(len(pl) AS BIGINT) AS n_pieces, pl[1] AS first_piece, pl[-1] AS last_piece,
       CAST(length(array_to_string(pl, '')) AS BIGINT) AS n_chars,
       md5(array_to_string(pl, ' ')) AS digest
FROM p""",
)
def q_tokenize(spark, sf_dir):
    found = fixtures.table(spark, sf_dir, "documents").select(
        "doc_id", tx.pieces(F.col("text")).alias("p")
    )
    return found.select(
        "doc_id", F.size("p").cast("long").alias("n_pieces"),
        F.get("p", F.lit(0)).alias("first_piece"), F.try_element_at("p", F.lit(-1)).alias("last_piece"),
        F.length(F.array_join("p", "")).cast("long").alias("n_chars"),
        F.md5(F.array_join("p", " ")).alias("digest"),
    )


_FOLDED = "replace(lower(piece), 'ß', 'ss')"


@query(
    "q_norm",
    rf"""WITH p AS (SELECT UNNEST({sql.pieces('text')}) AS piece FROM documents),
d AS (SELECT piece, count(*) AS uses FROM p GROUP BY piece)
SELECT piece, uses,
  regexp_replace(replace(replace({_FOLDED}, '’', ''''), '_', ''), '[^\p{{L}}\p{{N}}'']+', '', 'g') AS eval_form,
  regexp_replace(lower(piece), '[^\p{{L}}\p{{N}}_'']+', '', 'g') AS dedup_form,
  regexp_replace(lower(piece), '[^a-z]+', '', 'g') AS interjection_form,
  regexp_replace({_FOLDED}, '[^\p{{L}}\p{{N}}_]+', '', 'g') AS concat_form
FROM d""",
)
def q_norm(spark, sf_dir):
    found = fixtures.table(spark, sf_dir, "documents").select(
        F.explode(tx.pieces(F.col("text"))).alias("piece")
    )
    distinct = found.groupBy("piece").agg(F.count(F.lit(1)).alias("uses"))
    return tx.with_folded(stage(distinct, "pieces"), F.col("piece"), "folded").select(
        "piece", "uses",
        tx.evaluation_form(F.col("folded")).alias("eval_form"),
        tx.normalize_for_dedup(F.col("piece")).alias("dedup_form"),
        tx.normalize_for_interjection(F.col("piece")).alias("interjection_form"),
        tx.concat_form(F.col("folded")).alias("concat_form"),
    )


@query(
    "q_proportional",
    f"""WITH {sql.WORDS}
SELECT track_id, word_no, {sql.ms('start')} AS start_ms, {sql.ms('"end"')} AS end_ms FROM words""",
)
def q_proportional(spark, sf_dir):
    return fixtures.words(spark, sf_dir).select(
        "track_id", "word_no", to_ms(F.col("start")).alias("start_ms"),
        to_ms(F.col("end")).alias("end_ms"),
    )


@query(
    "q_offsets",
    f"""WITH RECURSIVE {sql.LINE_STEPS}
SELECT track_id, line_no, CAST(coalesce(sum(n_words) OVER (PARTITION BY track_id ORDER BY line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS word_offset
FROM lines""",
)
def q_offsets(spark, sf_dir):
    lines = stage(line_rows(spark, sf_dir).select("track_id", "line_no", "words"), "numbered")
    return ln.line_word_offsets(lines).select("track_id", "line_no", "word_offset")


@query(
    "q_timeline",
    f"""WITH RECURSIVE {sql.LINE_STEPS},
flat AS (
  SELECT s.track_id, l.line_no, s.start, s."end", s.text, s.kind, s.rn - l.first_rn AS within
  FROM step s JOIN lines l
    ON l.track_id = s.track_id AND l.kind = s.kind AND l.line_rn = s.line_rn),
refs AS (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY line_no, within) - 1 AS ref_no FROM flat)
SELECT track_id, line_no, ref_no, text, {sql.ms('start')} AS start_ms,
  row_number() OVER (PARTITION BY track_id ORDER BY start, "end", ref_no) - 1 AS idx
FROM refs""",
)
def q_timeline(spark, sf_dir):
    lines = stage(line_rows(spark, sf_dir, offsets=True).select("track_id", "line_no", "words", "word_offset"), "numbered")
    return ln.word_timeline(lines).select(
        "track_id", "line_no", "ref_no", "text", to_ms(F.col("start")).alias("start_ms"), "idx"
    )


@query(
    "q_line_timeline",
    f"""WITH RECURSIVE {sql.LINE_STEPS},
padded AS (SELECT track_id, line_no, kind, start - 0.03e0 AS start, "end" + 0.24e0 AS "end" FROM lines)
SELECT track_id, line_no, kind, {sql.ms('start')} AS start_ms, {sql.ms('"end"')} AS end_ms,
  row_number() OVER (PARTITION BY track_id ORDER BY start, "end", line_no) - 1 AS idx
FROM padded""",
)
def q_line_timeline(spark, sf_dir):
    lines = stage(line_rows(spark, sf_dir).select("track_id", "line_no", "kind", "start", "end"), "numbered")
    return ln.line_timeline(lines).select(
        "track_id", "line_no", "kind", to_ms(F.col("start")).alias("start_ms"), to_ms(F.col("end")).alias("end_ms"), "idx"
    )


@query(
    "q_paren",
    rf"""WITH {sql.WORDS},
m AS (
  SELECT track_id, phrase, word_no, regexp_matches(text, '^["'']?[(\[]') AS opens,
         regexp_matches(text, '[)\]][^\p{{L}}\p{{N}}_]*$') AS closes
  FROM words),
f AS (
  SELECT *, CASE WHEN closes THEN FALSE WHEN opens THEN TRUE END AS after FROM m)
SELECT track_id, word_no, opens OR coalesce(last_value(after IGNORE NULLS) OVER (
    PARTITION BY track_id, phrase ORDER BY word_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS parenthetical
FROM f""",
)
def q_paren(spark, sf_dir):
    words = fixtures.words(spark, sf_dir)
    return ph.parenthetical_flags(words, ["track_id", "phrase"], "word_no", "text").select(
        "track_id", "word_no", "parenthetical"
    )


_LIST = ", ".join(f"'{w}'" for w in ph.INTERJECTIONS)


@query(
    "q_adlib_phrase",
    rf"""WITH sentences AS (
  SELECT doc_id, generate_subscripts(s, 1) AS no, UNNEST(s) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
p AS (
  SELECT doc_id, no, regexp_replace(text, '^{sql.SPACES}|{sql.SPACES}$', '', 'g') AS stripped,
         list_filter(list_transform({sql.pieces('text')},
           lambda p: regexp_replace(lower(p), '[^a-z]+', '', 'g')), lambda p: p <> '') AS norm
  FROM sentences),
h AS (SELECT *, len(list_filter(norm, lambda p: p IN ({_LIST}))) AS hits FROM p)
SELECT doc_id, count(*) AS n_lines, CAST(sum(hits) AS BIGINT) AS interjections,
  count(*) FILTER ((stripped LIKE '(%' AND stripped LIKE '%)')
    OR (starts_with(stripped, '[') AND ends_with(stripped, ']'))
    OR (len(norm) BETWEEN 1 AND 8 AND hits / len(norm) >= 0.70)) AS adlib_lines
FROM h GROUP BY doc_id""",
)
def q_adlib_phrase(spark, sf_dir):
    lines = fixtures.table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.split("text", "\n")).alias("text")
    )
    flagged = lines.withColumn("p", tx.pieces(F.col("text"))).select(
        "doc_id",
        ph.is_adlib_phrase(F.col("text"), F.col("p")).alias("is_adlib"),
        F.size(
            F.filter(
                F.transform("p", tx.normalize_for_interjection),
                lambda p: p.isin(*ph.INTERJECTIONS),
            )
        ).alias("hits"),
    )
    return flagged.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("hits").cast("long").alias("interjections"),
        F.count_if("is_adlib").alias("adlib_lines"),
    )


_HALLUCINATED = "|".join(tx.HALLUCINATIONS)


@query(
    "q_hallucination",
    f"""WITH all_texts AS (
  SELECT 'document' AS origin, doc_id AS id, text FROM documents
  UNION ALL SELECT 'page', page_id, html FROM pages)
SELECT origin, id, regexp_matches(text, '(?i)(?:{_HALLUCINATED})') AS hallucinated FROM all_texts""",
)
def q_hallucination(spark, sf_dir):
    documents = fixtures.table(spark, sf_dir, "documents").select(
        F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text"
    )
    pages = fixtures.table(spark, sf_dir, "pages").select(
        F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text")
    )
    return documents.unionByName(pages).select(
        "origin", "id", tx.is_hallucination(F.col("text")).alias("hallucinated")
    )
