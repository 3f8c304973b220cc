"""Sanitisation, fill-in-middle and ranked search against plain statements of their rules."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cuesheet.llm import infill, sanitise, search

CLASHES = ("digest", "row", "term", "terms", "tf", "m", "block", "item", "n", "form", "h1", "output", "base", "runs", "kind", "entity",
           "share", "found", "spans", "docs", "score", "rank", "values", "pieces", "steps", "email", "key", "extra", "copies")
DOCS = "doc_id long, text string"


def with_clashes(df):
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df


def table(spark, rows, schema=DOCS, parts=3):
    return with_clashes(spark.createDataFrame(rows, schema).repartition(parts))


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(seed, count, letters="abcdefghijklmnop"):
    dice = random.Random(seed)
    return " ".join("".join(dice.choice(letters) for _ in range(dice.randint(1, 7))) for _ in range(count))


# ---- fill-in-middle


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abé字🎵é "), max_size=400), st.integers(1, 126), st.integers(1, 64))
def test_rank_index_finds_every_boundary(text, error, piece):
    data = text.encode()
    index = infill.RankIndex(data, error, piece)
    assert index.count == len(text)
    assert [index.offset(k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert all(abs(index.predict(k) - index.offset(k)) <= error + 1 for k in range(len(text)))


def test_rank_index_needs_few_segments_for_long_texts():
    text = "plain " * 300_000 + "".join(random.Random(1).choices("abcdeé", k=200_000)) + "字" * 400_000
    index = infill.RankIndex(text.encode())
    assert index.residuals.nbytes == len(text) and len(index.ranks) < 500
    for k in random.Random(2).sample(range(len(text) + 1), 50):
        assert index.offset(k) == len(text[:k].encode())
    with pytest.raises(ValueError):
        infill.RankIndex(b"", 127)


def plain_infill(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(text), "plain", None, None, text
    a, b, c = text[:low], text[low:high], text[high:]
    spm = h4 % 100 < 20
    return doc_id, len(text), "spm" if spm else "psm", low, high - low, f"<S>{c}<P>{a}<M>{b}" if spm else f"<P>{a}<S>{c}<M>{b}"


def test_fill_in_middle_equals_its_rule_and_round_trips(spark):
    texts = [words(n, 40) for n in range(60)] + [None, "", "x", "é", "a<P>b", "<M>", "<<S>", "<", "tail <P", "🎵" * 50, "日本 é" * 30]
    texts += [words(7, 400_000)]  # above PIECE bytes
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "no id at all"), (None, None)]
    made = infill.fill_in_middle(table(spark, rows))
    assert sorted_rows(made) == sorted((plain_infill(*r) for r in rows), key=repr)
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
    digests = infill.infill_digest(made).collect()
    assert Counter(r.restored_sha256 for r in digests) == Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert sorted_rows(made.select(infill.restored().alias("t"))) == sorted(((t or "",) for _, t in rows), key=repr)
    assert infill.fill_in_middle(table(spark, [])).count() == 0


def test_fill_in_middle_takes_other_rates_and_sentinels(spark):
    docs = table(spark, [(n, words(n, 9)) for n in range(50)] + [(99, "has (p) in it")])
    made = infill.fill_in_middle(docs, plain_percent=0, spm_percent=100, sentinels=("(p)", "(s)", "(m)"))
    forms = Counter(r.form for r in made.collect())
    assert forms == {"spm": 50, "plain": 1}
    back = {r.doc_id: r.t for r in made.select("doc_id", infill.restored(("(p)", "(s)", "(m)")).alias("t")).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


# ---- ranked search


def terms_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(rows, queries, top=20):
    docs = [(i, Counter(terms_of(t))) for i, t in rows]
    docs = [d for d in docs if d[1]]
    total, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in queries:
        asked, scores = Counter(terms_of(text)), []
        for doc_id, c in docs:
            m = 75 + 25 * sum(c.values()) * total // length
            score = sum(k * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t, k in asked.items() if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, n, s[3], -s[0]) for n, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    dice = random.Random(5)
    vocab = [f"w{n}" for n in range(150)] + ["Ünïcode", "字", "ABC", "x9"]
    weights = [1 / (n + 1) for n in range(len(vocab))]
    texts = [" ".join(dice.choices(vocab, weights, k=dice.choice((1, 3, 12, 12, 40, 200)))) for _ in range(300)]
    texts += [None, "", " ... ", texts[0], texts[0], " ".join(dice.choices(vocab, weights, k=30_000)), "only-here once", "w1 " * 50]
    rows = list(enumerate(texts)) + [(7, texts[7]), (7, "w3 other text"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (None, None)]
    return rows


QUERIES = [(0, "w1 w2 w3 w1"), (1, "w140 W149 ünïcode abc ABC"), (2, None), (3, ""), (4, "never seen"), (5, "only here once"), (0, "字 x9"), (None, "w0 w5"), (6, "w0 " * 30)]


def test_search_equals_brute_force(spark, corpus):
    index = search.build_index(table(spark, corpus), block_postings=300)
    queries = table(spark, QUERIES, "item_id long, text string")
    expected = plain_search(corpus, QUERIES)
    assert sorted_rows(search.search(index, queries)) == expected
    # one document as first visit, several passes over queries, and all strata in the first visit
    for first_docs, cells in ((1, 10), (10**9, 10**7)):
        assert sorted_rows(search.search(index, queries, first_docs=first_docs, cells=cells)) == expected
    assert sorted_rows(search.search(index, queries, top=3)) == plain_search(corpus, QUERIES, 3)


def test_search_index_is_stratified(spark, corpus):
    index = search.build_index(table(spark, corpus), block_postings=300)
    assert index.n_docs == sum(bool(terms_of(t)) for _, t in corpus) and index.n_terms == sum(len(terms_of(t)) for _, t in corpus)
    postings = index.postings.filter("term <> ''")
    assert postings.groupBy("m", "block", "term", "tf").count().filter("count > 1").count() == 0
    assert postings.agg(F.sum(F.size("docs"))).scalar() is not None
    hot = index.strata.orderBy(F.desc("n_docs")).first()
    blocks = index.postings.filter(F.col("m") == hot.m).select("block").distinct().count()
    assert blocks > 1  # a large stratum is dealt to several tasks


def test_search_of_nothing(spark, corpus):
    empty = search.build_index(table(spark, []))
    queries = table(spark, QUERIES, "item_id long, text string")
    assert search.search(empty, queries).count() == 0
    full = search.build_index(table(spark, corpus))
    assert search.search(full, queries.limit(0)).count() == 0
    assert search.search(full, table(spark, [(1, "zzz"), (2, None)], "item_id long, text string")).count() == 0


# ---- sanitisation

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for n, d in enumerate(reversed(digits)):
        d = int(d) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    only = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end(), m[0]) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end(), m[0]) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end(), m[0]) for m in CARD.finditer(text) if 12 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    found += [(m.start(), 3, m.end(), m[0]) for m in PHONE.finditer(text) if 9 <= len(only(m[0])) <= 15]
    return sorted(found)


def plain_terms(text, base):
    """(kind, entity, term, start, end) of the terms in the contexts."""
    runs = []
    for s in base:
        if runs and s[0] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], s[2])
            runs[-1][2].append(s)
        else:
            runs.append([s[0], s[2], [s]])
    out = []
    for n, (first, after, items) in enumerate(runs):
        left = runs[n - 1][1] if n else 0
        right = runs[n + 1][0] if n + 1 < len(runs) else len(text)
        for low, high, low_cut, high_cut in ((max(left, first - sanitise.WIDTH), first, first - sanitise.WIDTH > left, False),
                                             (after, min(right, after + sanitise.WIDTH), False, after + sanitise.WIDTH < right)):
            for m in re.finditer(sanitise.WORD, text[low:high]):
                if (low_cut and m.start() == 0) or (high_cut and m.end() == high - low):
                    continue
                for _, kind, _, value in items:
                    entity = re.sub("[^0-9]", "", value) if kind > 1 else value.lower()
                    out.append((kind, entity, re.sub("[A-Z]", lambda x: x[0].lower(), m[0]), low + m.start(), low + m.end()))
    return out


def plain_sanitise(rows, support, generalise, remove):
    texts = {t for _, t in rows if t}
    base = {t: plain_base(t) for t in texts | {""}}
    near = {t: plain_terms(t, base[t]) for t in base}
    named, pairs, held = defaultdict(set), defaultdict(set), defaultdict(set)
    for t in texts:
        for _, kind, _, value in base[t]:
            named[kind, re.sub("[^0-9]", "", value) if kind > 1 else value.lower()].add(t)
        for kind, entity, term, *_ in near[t]:
            pairs[kind, entity, term].add(t)
        for term in set(terms_of(t)):
            held[term].add(t)
    share = {}
    for (kind, entity, term), found in pairs.items():
        n_c, n_t, n = len(named[kind, entity]), len(held[term]), len(texts)
        if len(found) >= support and n_c < n:
            value = math.log(len(found) * n / (n_c * n_t)) / math.log(n / n_c)
            if value >= generalise - 1e-12:
                share[kind, entity, term] = value
    out = []
    for doc_id, t in rows:
        spans = [(sanitise.KINDS[k], a, b, v, "mask") for a, k, b, v in base[t or ""]]
        extra = {}
        for kind, entity, term, a, b in near[t or ""]:
            if (kind, entity, term) in share:
                extra[a, b, term] = max(extra.get((a, b, term), -9), share[kind, entity, term])
        spans += [("term", a, b, v, "remove" if s >= remove else "generalise") for (a, b, v), s in extra.items()]
        out.append((doc_id, sorted(spans, key=lambda s: (s[1], sanitise.KINDS.index(s[0]), s[2]))))
    return sorted(out, key=repr)


HARD = [
    "a@b.c_d@e.f x", "a@b", "x@y..z", "@a.b", "a.b.c@d-e.f-g.h. end", "mail:JOE@X.ORG,joe@x.org", "a@b.c@d.e@f.g",
    "1.2.3.4.5.6.7.8", "1.2.3.400.5.6.7.8", "256.1.1.1", "001.002.003.255", "1.2.3", "v1.2.3.4-5", "9.9.9.9.9",
    "4539 1488 0343 6467", "4539-1488-0343-6468", "4539  1488 0343 6467", "45391488034364671234567", "1 2 3", "0000 0000 0000",
    "é4539148803436467é", "+49 (171) 555-7713.", "+1 2", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "++49 171 5557713", "+4917155577134539148803436467",
    "+1 (017) 555-7713 a@b.cc 10.0.0.1", "+49 171 1234567.a@b.cd", "🎵🎵 a@b.cd 🎵 +49 171 1234567", "a" * 300 + "@" + "b" * 70 + ".c",
]


def personal_rows():
    dice = random.Random(11)
    rows = [(n, t) for n, t in enumerate(HARD)]
    common = [f"wort{n}" for n in range(40)]
    for n in range(60):
        body = " ".join(dice.choices(common, k=30))
        name = f"Anna{n % 6} Éclair{n % 6}"
        rows.append((100 + n, f"{body} {name} anna{n % 6}@mail.example.com, +49 171 55577{n % 6:02d} {body[:90]} nr{n % 6}"))
    rows += [(200 + n, " ".join(dice.choices(common, k=50)) + (" anna1" if n % 10 == 0 else "")) for n in range(60)]
    rows += [rows[35]] * 4 + [(None, rows[40][1]), (300, rows[41][1]), (301, None), (302, ""), (None, None)]
    rows.append((303, "x " * 40_000 + " ".join(f"Bob{n % 7} u{n % 7}@m.example.org" for n in range(900))))
    return rows


def as_rows(df):
    return sorted(((r.doc_id, [tuple(s) for s in r.found]) for r in df.collect()), key=repr)


def test_sanitisation_equals_brute_force(spark):
    rows = personal_rows()
    found = as_rows(sanitise.find_personal_data(table(spark, rows)))
    expected = plain_sanitise(rows, sanitise.SUPPORT, sanitise.GENERALISE, sanitise.REMOVE)
    assert found == expected
    actions = Counter(s[4] for _, spans in found for s in spans)
    assert actions["remove"] and actions["mask"]
    loose = as_rows(sanitise.find_personal_data(table(spark, rows), support=2, generalise=0.3, remove=0.99))
    assert loose == plain_sanitise(rows, 2, 0.3, 0.99)
    assert Counter(s[4] for _, spans in loose for s in spans)["generalise"]


def test_pairs_need_several_texts_and_copies_do_not_count(spark):
    once = "Xaver Unikat xaver@example.com said so"
    rows = [(n, once) for n in range(50)] + [(100 + n, words(n, 30)) for n in range(30)]
    found = as_rows(sanitise.find_personal_data(table(spark, rows)))
    assert {s[0] for _, spans in found for s in spans} == {"email"}
    assert all(not spans for doc_id, spans in found if doc_id >= 100)


def test_sanitised_texts(spark):
    rows = personal_rows()
    docs = table(spark, rows)
    clean = sanitise.sanitise_documents(docs)
    assert clean.columns == docs.columns
    spans = {}
    for n, (_, found) in enumerate(plain_sanitise([(f"{n:04d}", t) for n, (_, t) in enumerate(rows)], 3, 0.75, 0.9)):
        spans[n] = found
    expected = []
    for n, (doc_id, t) in enumerate(rows):
        out, last = [], 0
        for kind, a, b, value, action in spans[n]:
            if a >= last:
                label = sanitise.MASKS[kind] if action == "mask" else "" if action == "remove" else "[NUMBER]" if re.fullmatch("[0-9]+", value) else "[WORD]"
                out += [t[last:a], label]
            last = max(last, b)
        expected.append((doc_id, "".join(out) + t[last:] if t else t))
    assert sorted_rows(clean.select("doc_id", "text")) == sorted(expected, key=repr)
    assert not clean.filter(F.contains("text", F.lit("@mail.example.com"))).count()


def test_sanitisation_of_nothing(spark):
    assert sanitise.find_personal_data(table(spark, [])).count() == 0
    assert sanitise.sanitise_documents(table(spark, [])).count() == 0
    assert as_rows(sanitise.find_personal_data(table(spark, [(1, None), (2, "")]))) == [(1, []), (2, [])]


def test_patterns_take_linear_time(spark):
    long = "a" * 200_000 + " " + "1" * 200_000 + " " + "a.b" * 70_000 + "@" + " 1.2.3" * 30_000 + " x@" + "y." * 100_000 + "z"
    found = as_rows(sanitise.find_personal_data(table(spark, [(1, long)])))
    assert [s[0] for s in found[0][1]] == ["email"]


def test_sanitisation_equals_its_twin_where_terms_disclose(spark, tmp_path):
    import duckdb

    from cuesheet.llm.queries import ORACLES

    rows = [r for r in personal_rows() if r[0] is not None and r[0] != 303]
    docs = spark.createDataFrame(rows, DOCS)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    expected = connection.execute(ORACLES["op11_sanitise"]).fetchall()
    found = sanitise.personal_digest(sanitise.find_personal_data(docs))
    assert sorted_rows(found) == sorted(expected, key=repr) and any("term:" in r[-1] for r in expected)
