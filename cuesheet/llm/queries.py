"""Queries of this subpackage over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cuesheet.llm import decontaminate, infill, langid, neardup, packing, quality, sanitise, search, secrets, sharding, suffixes, urlfilter, warc
from cuesheet.llm.common import table
from cuesheet.plans.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
     d AS (SELECT page_id, strlen(h) n, sha256(h) s FROM p),
     f AS (SELECT s, min(page_id) first_id FROM d GROUP BY s)
SELECT page_id, n::BIGINT payload_bytes, s payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END refers_to
FROM d JOIN f USING (s)
""")
def op1_warc(spark, sf_dir):
    folder = shared_folder(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_sharding", """
WITH RECURSIVE
points AS (
  SELECT row_number() OVER (ORDER BY pos, shard, vnode) - 1 arc, * FROM (
    SELECT i // 64 shard, i % 64 vnode,
           ('0x' || substr(md5('point/' || (i // 64) || '/' || (i % 64)), 1, 15))::BIGINT pos
    FROM range(1024) r(i))),
keys AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 size, text,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT h
  FROM documents),
crc_table AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) tab
  FROM range(256) r(n)),
sums AS (
  SELECT text, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) crc
  FROM (SELECT text, list_transform(range(strlen(text)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) bytes
        FROM (SELECT DISTINCT coalesce(text, '') text, hex(encode(coalesce(text, ''))) h FROM documents)), crc_table),
homes AS (
  SELECT k.*, coalesce(p.arc, 0) arc, p.arc IS NOT NULL inner_part
  FROM keys k ASOF LEFT JOIN points p ON k.h <= p.pos),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY arc ORDER BY inner_part, h, doc_id, size) - 1 k FROM homes),
arcs AS (
  SELECT p.arc, p.shard, count(h.arc) n FROM points p LEFT JOIN homes h ON p.arc = h.arc GROUP BY ALL),
loads AS (
  SELECT *, least(before, cap) home_slot, greatest(0, least(n, cap - before)) kept,
         n - greatest(0, least(n, cap - before)) extra
  FROM (SELECT *, sum(n) OVER () // 16 + CASE WHEN shard < sum(n) OVER () % 16 THEN 1 ELSE 0 END cap,
               coalesce(sum(n) OVER (PARTITION BY shard ORDER BY arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before,
               sum(n) OVER (PARTITION BY shard) total
        FROM arcs)),
seqs AS (
  SELECT *, coalesce(sum(extra) OVER (ORDER BY arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) seq FROM loads),
homesize AS (SELECT list(least(total, cap) ORDER BY shard) home, list(cap - least(total, cap) ORDER BY shard) room
             FROM (SELECT DISTINCT shard, total, cap FROM loads)),
walk(t, room, carry, placed, shard, took, used) AS (
  SELECT 0, room, 0::HUGEINT, 0::HUGEINT, 0::BIGINT, 0::HUGEINT, 0::HUGEINT FROM homesize
  UNION ALL
  SELECT t + 1,
         list_transform(room, lambda r, i: CASE WHEN i = s + 1 THEN r - tk ELSE r END),
         incoming - tk, placed + tk, s, tk, full_room[s + 1] - room[s + 1]
  FROM (SELECT w.t, w.room, w.placed, q.shard s, z.room full_room,
               w.carry + CASE WHEN w.t < 1024 THEN q.extra ELSE 0 END incoming,
               least(w.carry + CASE WHEN w.t < 1024 THEN q.extra ELSE 0 END, w.room[q.shard + 1]) tk
        FROM walk w JOIN seqs q ON q.arc = w.t % 1024, homesize z WHERE w.t < 2048)),
steps AS (
  SELECT shard, placed - took first, placed after, home[shard + 1] + used slot FROM walk, homesize WHERE took > 0)
SELECT r.doc_id, r.size::BIGINT size, c.crc text_crc32, 'rows' law,
       (CASE WHEN k < kept THEN q.shard ELSE s.shard END)::INTEGER shard,
       (CASE WHEN k < kept THEN home_slot + k ELSE slot + seq + k - kept - first END)::BIGINT slot,
       NULL::INTEGER grown_shard
FROM ranked r JOIN seqs q USING (arc)
LEFT JOIN steps s ON k >= kept AND seq + k - kept >= first AND seq + k - kept < after
JOIN sums c ON c.text = coalesce(r.text, '')
""")
def op2_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op4_decontamination", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
pat AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') p
        FROM (SELECT *, unnest(range(1, len(w) - l + 2)) i FROM (SELECT *, least(10, len(w)) l FROM b WHERE len(w) > 0))),
win AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') p
        FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) i FROM d, (SELECT DISTINCT l FROM pat) WHERE len(w) >= l)),
occ AS (SELECT DISTINCT doc_id, i, l, item_id FROM win JOIN pat USING (l, p)),
hit AS (SELECT doc_id, count(DISTINCT x) n FROM (SELECT doc_id, unnest(range(i, i + l)) x FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) n, string_agg(s, ',' ORDER BY s) names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(hit.n, 0)::BIGINT n_hit, coalesce(its.n, 0)::BIGINT n_items,
       sha256(coalesce(names, '')) items_sha256, coalesce(hit.n, 0) > 0 contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""")
def op4_decontamination(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_digest(found)


@query("op10_quality", r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w FROM d),
tri AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT x) n FROM (
          SELECT doc_id, unnest(range(i, i + 3)) x FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) c FROM tri) WHERE c > 1)
        GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) - count(DISTINCT l) n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) l FROM d)
        WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(w)::BIGINT n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols,
             coalesce(lin.n, 0)::BIGINT n_dup_lines, coalesce(rep.n, 0)::BIGINT n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lin USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM m),
h AS (SELECT source, count(*) n, sum(base_failed::INT) k FROM f WHERE source IS NOT NULL GROUP BY source),
q AS (SELECT avg(k / n) m, CASE WHEN var_pop(k / n) > 0 THEN greatest(avg(k / n) * (1 - avg(k / n)) / var_pop(k / n) - 1, 1) END s FROM h),
v AS (SELECT source, coalesce((k + q.m * q.s) / (n + q.s), q.m) <= 0.5 good FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(good, true) kept
FROM f LEFT JOIN v USING (source)
""")
def op10_quality(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"))


@query("op3_langid")
def op3_langid(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op8_secrets")
def op8_secrets(spark, sf_dir):
    return secrets.secret_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query("op5_url_filters", r"""
WITH RECURSIVE
u AS (SELECT page_id, html, coalesce(url, '') url FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') path FROM u),
r AS (SELECT *, CASE WHEN fits('example.net', '/en/') THEN 'example.net/en/' WHEN fits('example.com', '/de/') THEN 'example.com/de/'
                     WHEN fits('org', '/fr/') THEN 'org/fr/' WHEN fits('net', '/') THEN 'net/' END rule FROM p),
v AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END ruling FROM r),
l AS (SELECT host src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1)) link FROM p),
e AS (SELECT src, dst, count(*) n FROM (
        SELECT src, translate(regexp_extract(CASE WHEN link LIKE '//%' THEN 'x:' || link ELSE link END, '^.*?://([^/?#]*)', 1, 's'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') dst FROM l)
      WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
w AS (SELECT 'trust' kind, src, dst, n / sum(n) OVER (PARTITION BY src) weight FROM e
      UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM e),
seeds AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) seed FROM (
            SELECT CASE ruling WHEN 'allow' THEN 'trust' ELSE 'distrust' END kind, host, count(*) n FROM v WHERE ruling IS NOT NULL GROUP BY ALL)),
added(step, kind, host, score) AS (
  SELECT 0, kind, host, 0.15 * seed FROM seeds
  UNION ALL
  SELECT step, kind, host, sum(score) FROM (
    SELECT k.step + 1 step, k.kind, w.dst host, 0.85 * k.score * w.weight score FROM added k JOIN w ON w.kind = k.kind AND w.src = k.host WHERE k.step < 128)
  GROUP BY step, kind, host),
h AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END) t, sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) d
      FROM added GROUP BY host)
SELECT page_id, v.host, path, rule, coalesce(ruling, CASE WHEN d > 0.5 * (t + d) THEN 'block' ELSE 'allow' END) verdict
FROM v LEFT JOIN h ON h.host = v.host
""".replace("fits('example.net', '/en/')", "(host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/')")
   .replace("fits('example.com', '/de/')", "(host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/')")
   .replace("fits('org', '/fr/')", "(host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/')")
   .replace("fits('net', '/')", "(host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/')"))
def op5_url_filters(spark, sf_dir):
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


@query("op9_packing")
def op9_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_minhash", r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') g FROM (
        SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT b.b, r.seen FROM reach r JOIN both_ways b ON b.a = r.node),
c AS (SELECT node, min(seen) component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n.n, 0)::BIGINT n_shingles, coalesce(component_id, doc_id) component_id, coalesce(component_id, doc_id) = doc_id kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON node = doc_id
""")
def op6_minhash(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_suffix_array")
def op7_suffix_array(spark, sf_dir):
    return suffixes.removal_digest(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


@query("op12_infill", """
WITH d AS (SELECT doc_id, coalesce(text, '') t, length(coalesce(text, '')) n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) h FROM documents),
h AS (SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) b,
             ('0x' || substr(h, 17, 8))::BIGINT % 100 c, ('0x' || substr(h, 25, 8))::BIGINT % 100 d FROM d),
f AS (SELECT doc_id, t, n, least(a, b) p, greatest(a, b) q,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain'
                  WHEN d < 20 THEN 'spm' ELSE 'psm' END form FROM h),
c AS (SELECT doc_id, t, n, form, p, q, substr(t, 1, p) x, substr(t, p + 1, q - p) y, substr(t, q + 1) z FROM f)
SELECT doc_id, n::BIGINT n, form, CASE WHEN form <> 'plain' THEN p END prefix_chars, CASE WHEN form <> 'plain' THEN q - p END middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) output_sha256,
       sha256(t) restored_sha256
FROM c
""")
def op12_infill(spark, sf_dir):
    return infill.infill_digest(infill.fill_in_middle(table(spark, sf_dir, "documents")))


@query("op13_search", r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t FROM documents),
asked AS (SELECT item_id, t, count(*) c FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t FROM benchmark) GROUP BY ALL),
lens AS (SELECT doc_id, count(*) n FROM terms GROUP BY doc_id),
total AS (SELECT count(*) nn, sum(n)::BIGINT ll FROM lens),
norms AS (SELECT doc_id, 75 + (25 * n * nn) // ll m FROM lens, total),
tf AS (SELECT doc_id, t, count(*) tf FROM terms SEMI JOIN asked USING (t) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT w FROM (SELECT t, count(*) df FROM tf GROUP BY t), total),
s AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT score
      FROM asked JOIN w USING (t) JOIN tf USING (t) JOIN norms USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
""")
def op13_search(spark, sf_dir):
    index = search.build_index(table(spark, sf_dir, "documents"))
    return search.search(index, table(spark, sf_dir, "benchmark"))


_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _placed(source: str, keys: str, text: str, pattern: str) -> str:
    """SQL: matches v of a pattern with their ends e inside the text."""
    return f"""
      SELECT {keys}, v, sum(length(g) + length(v)) OVER (PARTITION BY {keys} ORDER BY i) e FROM (
        SELECT {keys}, unnest(f) v, unnest(p[1:len(f)]) g, generate_subscripts(f, 1) i FROM (
          SELECT {keys}, regexp_extract_all({text}, '{pattern}') f, string_split_regex({text}, '{pattern}') p FROM {source}) WHERE len(f) > 0)"""


@query("op11_sanitise", rf"""
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t FROM documents),
found AS (
  SELECT r, 0 kind, v, e FROM ({_placed("(SELECT * FROM d WHERE contains(t, '@'))", "r", "t", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")})
  UNION ALL SELECT r, 1, v, e FROM ({_placed("d", "r", "t", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")})
  UNION ALL SELECT r, 2, v, e FROM ({_placed("d", "r", "t", r"[0-9](?:[\x20-]?[0-9])+")})
  UNION ALL SELECT r, 3, v, e FROM ({_placed("(SELECT * FROM d WHERE contains(t, '+'))", "r", "t", r"\+[0-9][\x20().0-9-]+[0-9]")})),
digits AS (SELECT r, kind, v, e, regexp_replace(v, '[^0-9]', '', 'g') n FROM found),
base AS (
  SELECT r, kind, (e - length(v))::BIGINT s, e::BIGINT e,
         CASE WHEN kind > 1 THEN n ELSE translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END entity
  FROM digits WHERE CASE kind WHEN 0 THEN true WHEN 1 THEN regexp_full_match(v, '{_PART}(?:\.{_PART}){{3}}')
    WHEN 2 THEN length(n) BETWEEN 12 AND 19 AND list_sum(list_transform(string_split(reverse(n), ''),
      lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0
    ELSE length(n) BETWEEN 9 AND 15 END),
marked AS (SELECT *, max(e) OVER (PARTITION BY r ORDER BY s, kind, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM base),
runs AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s, kind, e) run FROM marked),
edges AS (
  SELECT r, run, a, b, t, coalesce(lag(b) OVER w, 0) lo, coalesce(lead(a) OVER w, length(t)) hi
  FROM (SELECT r, run, min(s) a, max(e) b FROM runs GROUP BY ALL) JOIN d USING (r) WINDOW w AS (PARTITION BY r ORDER BY run)),
contexts AS (
  SELECT r, run, 0 side, greatest(lo, a - 64) origin, substr(t, greatest(lo, a - 64) + 1, a - greatest(lo, a - 64)) c, a - 64 > lo low, false high FROM edges
  UNION ALL SELECT r, run, 1, b, substr(t, b + 1, least(hi, b + 64) - b), false, b + 64 < hi FROM edges),
near AS (
  SELECT r, run, translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term, (origin + e - length(v))::BIGINT s, (origin + e)::BIGINT e
  FROM ({_placed("contexts", "r, run, side", "c", _WORDS)}) JOIN contexts USING (r, run, side)
  WHERE NOT (low AND e = length(v)) AND NOT (high AND e = length(c))),
named AS (SELECT kind, entity, count(DISTINCT t) n_c FROM base JOIN d USING (r) GROUP BY ALL HAVING n_c >= 3),
beside AS (SELECT r, t, kind, entity, term, n.s, n.e FROM near n JOIN runs USING (r, run) JOIN d USING (r) SEMI JOIN named USING (kind, entity)),
pairs AS (SELECT kind, entity, term, count(DISTINCT t) n_ct FROM beside GROUP BY ALL HAVING n_ct >= 3),
held AS (
  SELECT term, count(*) n_t FROM (
    SELECT DISTINCT t, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}')) term
    FROM (SELECT DISTINCT t FROM d)) GROUP BY term),
total AS (SELECT count(DISTINCT t) n FROM d WHERE t <> ''),
shares AS (
  SELECT kind, entity, term FROM pairs JOIN named USING (kind, entity) JOIN held USING (term), total
  WHERE n_c < n AND ln(n_ct * n / (n_c * n_t)) / ln(n / n_c) >= 0.75),
spans AS (
  SELECT r, s, kind, e FROM base UNION ALL SELECT DISTINCT r, s, 4, e FROM beside SEMI JOIN shares USING (kind, entity, term)),
texts AS (SELECT *, ['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || s || ':' || e x FROM spans),
lists AS (
  SELECT r, count(*) FILTER (kind = 0) n_email, count(*) FILTER (kind = 1) n_ip, count(*) FILTER (kind = 2) n_card, count(*) FILTER (kind = 3) n_phone,
         string_agg(x, ',' ORDER BY s, kind, e) FILTER (kind < 4) base, string_agg(x, ',' ORDER BY s, kind, e) spans
  FROM texts GROUP BY r)
SELECT doc_id, coalesce(n_email, 0)::BIGINT n_email, coalesce(n_ip, 0)::BIGINT n_ip, coalesce(n_card, 0)::BIGINT n_card, coalesce(n_phone, 0)::BIGINT n_phone,
       sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
FROM d LEFT JOIN lists USING (r)
""")
def op11_sanitise(spark, sf_dir):
    return sanitise.personal_digest(sanitise.find_personal_data(table(spark, sf_dir, "documents")))
