"""SQL text shared by the oracle queries (DuckDB dialect, tables as pre-registered views)."""

from __future__ import annotations

SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def rounded(x: str, digits: int = 3) -> str:
    """Correct rounding of the binary value of column ``x`` (half to even)."""
    scale = f"1e{digits}"
    p = f"({x} * {scale})"
    hi = f"({x} * 134217729e0 - ({x} * 134217729e0 - {x}))"
    err = f"(({hi} * {scale} - {p}) + ({x} - {hi}) * {scale})"
    tie = f"{p} - floor({p}) = 0.5e0"
    return (
        f"(CASE WHEN {tie} AND {err} > 0 THEN floor({p}) + 1 "
        f"WHEN {tie} AND {err} < 0 THEN floor({p}) ELSE round_even({p}, 0) END / {scale})"
    )


def ms(x: str) -> str:
    return f"CAST(round_even(({x}) * 1e3, 0) AS BIGINT)"


def pieces(text: str) -> str:
    return (
        f"list_filter(regexp_split_to_array({text}, '{SPACES}'), "
        r"lambda p: regexp_matches(p, '[\p{L}\p{N}]'))"
    )


def weight(text: str) -> str:
    return (
        rf"greatest(1e0, pow(CAST(length(regexp_replace({text}, '[^\p{{L}}\p{{N}}]+', '', 'g')) "
        "AS DOUBLE), 0.72e0))"
    )


# Phrases and words derived from conversations (see cuesheet.fixtures).
PHRASES = f"""
phrases AS (
  SELECT conv_id AS track_id, CAST(turn AS INT) AS phrase,
         CASE WHEN role = 'assistant' THEN 'adlib' ELSE 'lead' END AS kind, text,
         turn * 30e0 AS phrase_start, {pieces('text')} AS piece_list
  FROM conversations)"""

WORDS = f"""{PHRASES},
pieces AS (
  SELECT track_id, phrase, kind, phrase_start, len(piece_list) * 0.35e0 AS secs,
         UNNEST(piece_list) AS text, generate_subscripts(piece_list, 1) - 1 AS pos
  FROM phrases),
weighed AS (
  SELECT *, sum({weight('text')}) OVER (PARTITION BY track_id, phrase ORDER BY pos) AS cum,
         coalesce(sum({weight('text')}) OVER (PARTITION BY track_id, phrase ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
  FROM pieces),
shared AS (
  SELECT *, max(cum) OVER (PARTITION BY track_id, phrase) AS total FROM weighed),
raw_times AS (
  SELECT *, phrase_start + greatest(0.04e0, secs) * (prev / total) AS f,
         phrase_start + greatest(0.04e0, secs) * (cum / total) AS t FROM shared),
words AS (
  SELECT track_id, phrase * 4294967296 + pos AS word_no, text, {rounded('f')} AS start,
         {rounded('t')} AS "end", kind, phrase
  FROM raw_times)"""

# Greedy line grouping by recursion over the words of each (track, kind).
LINE_STEPS = f"""{WORDS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY track_id, kind ORDER BY start, "end", word_no) AS rn
  FROM words),
step AS (
  SELECT *, 1 AS cnt, start AS first, rn AS line_rn FROM ranked WHERE rn = 1
  UNION ALL
  SELECT track_id, word_no, text, start, "end", kind, phrase, rn,
         CASE WHEN brk THEN 1 ELSE cnt + 1 END, CASE WHEN brk THEN start ELSE first END,
         CASE WHEN brk THEN rn ELSE line_rn END
  FROM (
    SELECT r.*, s.cnt, s.first, s.line_rn,
      (r.start - s."end" > CASE r.kind WHEN 'adlib' THEN 0.9e0 ELSE 0.52e0 END)
      OR s.cnt >= CASE r.kind WHEN 'adlib' THEN 7 ELSE 12 END
      OR (r."end" - s.first > CASE r.kind WHEN 'adlib' THEN 5.2e0 ELSE 7.2e0 END)
      OR (s.cnt >= 3 AND regexp_matches(s.text, '[.!?…]$'))
      OR (r.phrase <> s.phrase AND (r.start - s."end" > 0.06e0 OR s.cnt >= 4
          OR r."end" - s.first >= 2.5e0)) AS brk
    FROM step s JOIN ranked r
      ON r.track_id = s.track_id AND r.kind = s.kind AND r.rn = s.rn + 1)),
grouped AS (
  SELECT track_id, kind, line_rn, min(rn) AS first_rn, arg_min(start, rn) AS start,
         arg_max("end", rn) AS "end", arg_min(word_no, rn) AS first_word,
         arg_min("end", rn) AS first_end, count(*) AS n_words,
         string_agg(text, ' ' ORDER BY rn) AS line_text
  FROM step GROUP BY track_id, kind, line_rn),
lines AS (
  SELECT *, row_number() OVER (PARTITION BY track_id
           ORDER BY start, kind <> 'lead', first_end, first_word) - 1 AS line_no
  FROM grouped)"""

# Events as time intervals in seconds since 2024-01-01; probe times every six hours.
INTERVALS = """
intervals AS (
  SELECT user_id AS track_id, event_id AS interval_id, event_type,
         (epoch_us(ts) - 1704067200000000) / 1e6 AS start,
         (epoch_us(ts) - 1704067200000000) / 1e6 + value * 60e0 AS "end"
  FROM events)"""

PROBES = f"""{INTERVALS},
probes AS (
  SELECT track_id, first + k * 21600e0 AS t
  FROM (SELECT track_id, min(start) AS first FROM intervals GROUP BY track_id),
       (SELECT UNNEST(range(0, 120)) AS k))"""

# Hourly event energy as frames, and the chain from frames to regions.
FRAMES = """
cells AS (
  SELECT user_id AS track_id, CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000) AS BIGINT)
         AS frame_no, sqrt(sum(value * value) / count(*)) AS rms
  FROM events GROUP BY ALL),
frames AS (
  SELECT u.track_id, h.frame_no, coalesce(c.rms, 0e0) AS rms
  FROM (SELECT DISTINCT user_id AS track_id FROM events) u
  CROSS JOIN (SELECT UNNEST(range(0, 720)) AS frame_no) h
  LEFT JOIN cells c ON c.track_id = u.track_id AND c.frame_no = h.frame_no)"""

LEVELS = f"""{FRAMES},
stats AS (
  SELECT track_id, quantile_cont(rms, 0.18) AS noise_floor, max(rms) AS peak, count(*) AS n_frames
  FROM frames GROUP BY track_id),
padded AS (
  SELECT track_id, frame_no, rms FROM frames
  UNION ALL SELECT track_id, frame_no - k, rms FROM frames, range(1, 61) t(k) WHERE frame_no = 0
  UNION ALL SELECT track_id, frame_no + k, rms FROM frames, range(1, 61) t(k) WHERE frame_no = 719),
refs AS (
  SELECT track_id, frame_no, rms,
    least(quantile_cont(rms, 0.85) OVER (PARTITION BY track_id ORDER BY frame_no
            ROWS BETWEEN 60 PRECEDING AND CURRENT ROW),
          quantile_cont(rms, 0.85) OVER (PARTITION BY track_id ORDER BY frame_no
            ROWS BETWEEN CURRENT ROW AND 60 FOLLOWING)) AS local_ref
  FROM padded),
levels AS (
  SELECT r.*, greatest(25e-5, noise_floor + greatest(0e0, local_ref - noise_floor) * 0.2e0) AS on_level,
         greatest(18e-5, noise_floor + greatest(0e0, local_ref - noise_floor) * 75e-3) AS off_level
  FROM refs r JOIN stats s USING (track_id) WHERE frame_no BETWEEN 0 AND 719)"""

ACTIVE = f"""{LEVELS},
decided AS (
  SELECT *, CASE WHEN rms >= on_level THEN TRUE WHEN rms < off_level THEN FALSE END AS d FROM levels),
activity AS (
  SELECT track_id, frame_no, rms, coalesce(last_value(d IGNORE NULLS) OVER (
    PARTITION BY track_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING), FALSE) AS active
  FROM decided)"""

RUNS = f"""{ACTIVE},
isl AS (
  SELECT *, frame_no - row_number() OVER (PARTITION BY track_id, active ORDER BY frame_no) AS g
  FROM activity),
all_runs AS (
  SELECT track_id, active, min(frame_no) AS a, max(frame_no) AS b FROM isl GROUP BY track_id, active, g),
filled AS (
  SELECT track_id, a, b, active OR (a > 0 AND b < 719 AND b - a + 1 <= 18) AS active FROM all_runs),
fr AS (SELECT f.track_id, x.frame_no, f.active FROM filled f, LATERAL (SELECT UNNEST(range(a, b + 1)) AS frame_no) x),
isl2 AS (
  SELECT *, frame_no - row_number() OVER (PARTITION BY track_id ORDER BY frame_no) AS g
  FROM fr WHERE active),
runs AS (
  SELECT track_id, min(frame_no) AS first_frame, max(frame_no) AS last_frame
  FROM isl2 GROUP BY track_id, g HAVING count(*) >= 2)"""

REGIONS = f"""{RUNS},
wide AS (
  SELECT track_id, greatest(0, first_frame * 800 - 4480) AS s,
         least(576000, (last_frame + 1) * 800 + 4480) AS e FROM runs),
marked AS (
  SELECT *, max(e) OVER (PARTITION BY track_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
  FROM wide),
numbered AS (
  SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY s, e) AS g
  FROM marked),
merged AS (SELECT track_id, min(s) AS s, max(e) AS e FROM numbered GROUP BY track_id, g),
ranked_runs AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY s) AS rn FROM merged),
joined AS (
  SELECT track_id, rn, s, e, s AS rs FROM ranked_runs WHERE rn = 1
  UNION ALL
  SELECT r.track_id, r.rn, r.s, r.e,
         CASE WHEN r.e - j.rs <= 456000 AND r.s - j.e <= 96000 THEN j.rs ELSE r.s END
  FROM joined j JOIN ranked_runs r ON r.track_id = j.track_id AND r.rn = j.rn + 1),
regions AS (SELECT track_id, rs AS s, max(e) AS e FROM joined GROUP BY track_id, rs),
cuts AS (
  SELECT track_id, s, e, 0 AS depth FROM regions
  UNION ALL
  SELECT track_id, cut, e, depth + 1 FROM (
    SELECT c.track_id, c.e, c.depth, least(c.e - 3200, greatest(c.s + 256000,
      (SELECT arg_min(f.frame_no, struct_pack(r := f.rms, n := f.frame_no)) FROM frames f
       WHERE f.track_id = c.track_id AND f.frame_no >= (c.s + 256000) // 800
         AND f.frame_no < (c.s + 456000) // 800) * 800)) AS cut
    FROM cuts c WHERE c.e - c.s > 456000)),
pieces_of_region AS (
  SELECT track_id, s, coalesce(lead(s) OVER (PARTITION BY track_id, e ORDER BY s), e) AS e FROM cuts)"""

SAMPLES = """
flat AS (
  SELECT vec_id // 16 AS track_id, (vec_id % 16) * 64 + generate_subscripts(embedding, 1) - 1 AS idx,
         UNNEST(embedding) AS v FROM embeddings),
samples AS (
  SELECT track_id, idx, CAST(v AS DOUBLE) * CASE WHEN track_id % 2 = 0 AND idx BETWEEN 300 AND 700
         THEN 0.01e0 ELSE 1e0 END AS v FROM flat),
sizes AS (SELECT track_id, max(idx) + 1 AS n_samples FROM samples GROUP BY track_id)"""

# Benchmark texts as references and two damaged copies of each as candidates.
EVAL_TOKENS = f"""
rp AS (SELECT item_id AS track_id, {pieces('text')} AS p FROM benchmark),
rw AS (
  SELECT track_id, len(p) AS n, generate_subscripts(p, 1) - 1 AS pos, UNNEST(p) AS text FROM rp),
rt AS (
  SELECT *, sum({weight('text')}) OVER (PARTITION BY track_id ORDER BY pos) AS cum,
    coalesce(sum({weight('text')}) OVER (PARTITION BY track_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev,
    sum({weight('text')}) OVER (PARTITION BY track_id) AS total,
    lead(text, 1, 'end') OVER (PARTITION BY track_id ORDER BY pos) AS next
  FROM rw),
rs AS (SELECT *, n * 0.35e0 * (prev / total) AS f, n * 0.35e0 * (cum / total) AS t FROM rt),
reference AS (
  SELECT track_id, pos, text, next, {rounded('f')} AS start, {rounded('t')} AS "end" FROM rs),
rules(label, d, r, i) AS (VALUES ('first', 7, 11, 13), ('second', 5, 9, 17)),
damaged AS (
  SELECT track_id, label, pos * 2 AS pos,
         CASE WHEN (pos + 1) % r = 0 THEN next ELSE text END AS text,
         start + (pos + 40) / 1000e0 AS start, "end" + (pos + 40) / 1000e0 * 1.5e0 AS "end"
  FROM reference, rules WHERE (pos + 1) % d <> 0
  UNION ALL
  SELECT track_id, label, pos * 2 + 1, 'filler', start + (pos + 40) / 1000e0,
         "end" + (pos + 40) / 1000e0 * 1.5e0
  FROM reference, rules WHERE (pos + 1) % i = 0),
ref AS (
  SELECT track_id, pos, text, start, "end",
    regexp_replace(replace(replace(lower(text), 'ß', 'ss'), '_', ''), '[^\\p{{L}}\\p{{N}}'']+', '', 'g') AS norm
  FROM reference),
cand AS (
  SELECT track_id, label, pos, text, start, "end",
    regexp_replace(replace(replace(lower(text), 'ß', 'ss'), '_', ''), '[^\\p{{L}}\\p{{N}}'']+', '', 'g') AS norm
  FROM damaged)"""

# Edit table by recursion over its anti-diagonals; each cell carries its best path.
EDIT_PATHS = f"""{EVAL_TOKENS},
refn AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY pos) AS no FROM ref WHERE norm <> ''),
candn AS (SELECT *, row_number() OVER (PARTITION BY track_id, label ORDER BY pos) AS no FROM cand WHERE norm <> ''),
pairs AS (
  SELECT c.track_id, c.label, max(c.no) AS m, (SELECT max(no) FROM refn r WHERE r.track_id = c.track_id) AS n
  FROM candn c GROUP BY c.track_id, c.label),
moves(mv, di, dj, needs_cur) AS (VALUES ('D', 1, 0, TRUE), ('I', 0, 1, TRUE), ('K', 0, 0, TRUE), ('X', 1, 1, FALSE)),
dp AS (
  SELECT track_id, label, n, m, 0 AS i, 0 AS j, 0 AS cost, '' AS path, CAST([] AS DOUBLE[]) AS onsets,
         CAST([] AS DOUBLE[]) AS offsets, TRUE AS cur FROM pairs
  UNION ALL
  SELECT track_id, label, n, m, i, j, cost, path, onsets, offsets, cur FROM (
    SELECT *, row_number() OVER (PARTITION BY track_id, label, i, j, cur ORDER BY cost, prio) AS rn FROM (
      SELECT d.track_id, d.label, d.n, d.m, d.i + di AS i, d.j + dj AS j, mv <> 'K' AS cur,
        cost + CASE WHEN mv = 'K' OR (mv = 'X' AND r.norm = c.norm) THEN 0 ELSE 1 END AS cost,
        path || CASE WHEN mv = 'X' AND r.norm = c.norm THEN 'M' WHEN mv = 'X' THEN 'S'
                     WHEN mv = 'K' THEN '' ELSE mv END AS path,
        CASE WHEN mv = 'X' AND r.norm = c.norm THEN list_append(onsets, c.start - r.start) ELSE onsets END AS onsets,
        CASE WHEN mv = 'X' AND r.norm = c.norm THEN list_append(offsets, c."end" - r."end") ELSE offsets END AS offsets,
        CASE mv WHEN 'X' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS prio
      FROM dp d JOIN moves ON needs_cur = d.cur
      LEFT JOIN refn r ON di = 1 AND r.track_id = d.track_id AND r.no = d.i + 1
      LEFT JOIN candn c ON dj = 1 AND c.track_id = d.track_id AND c.label = d.label AND c.no = d.j + 1
      WHERE d.i + di <= d.n AND d.j + dj <= d.m)
  ) WHERE rn = 1),
best AS (SELECT * FROM dp WHERE i = n AND j = m AND cur)"""

# Events as short words (see cuesheet.fixtures.beats).
BEATS = f"""
b0 AS (
  SELECT user_id AS track_id, event_id AS word_no, event_type AS text,
         (epoch_us(ts) - 1704067200000000) / 3.6e9 * 0.1e0 AS s0, value,
         list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS type_no
  FROM events),
b1 AS (SELECT *, {rounded('s0')} AS start FROM b0),
b2 AS (SELECT *, start + 0.04e0 + value * 0.01e0 AS e0 FROM b1),
beats AS (
  SELECT track_id, word_no, text, start, {rounded('e0')} AS "end",
    CASE WHEN word_no % 4 = 0 THEN 'adlib' ELSE 'lead' END AS kind,
    CAST(CASE WHEN word_no % 7 = 0 THEN -1 ELSE floor(start / 2.4e0) * 5 + type_no END AS INT) AS phrase
  FROM b2)"""
