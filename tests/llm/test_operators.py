"""Operators on small tables with nulls, ties, repeats and clashing columns, against plain statements of the rules."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cuesheet.llm import decontaminate, langid, neardup, packing, quality, secrets, sharding, suffixes, urlfilter, warc
from cuesheet.llm.components import components
from cuesheet.plans.session import shared_folder

CLASHES = ("digest", "key", "node", "h", "cell", "host", "label", "bands", "rule", "items", "group", "id", "dropped_id",
           "first", "order", "rank", "n", "spans", "uid", "text_crc32", "kept", "shingles", "component")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"word{n} of the shared passage" for n in range(30))


def words(seed: int, count: int) -> str:
    dice = random.Random(seed)
    return " ".join("".join(dice.choice("abcdefghijklmnop") for _ in range(dice.randint(2, 8))) for _ in range(count))


def documents():
    """Copies, near copies, nulls, empty, tiny, one long text and repeated rows."""
    base, texts = words(1, 120).split(), []
    texts += [" ".join(base)] * 3
    for n in range(6):
        near = list(base)
        near[10 + n] = f"changed{n}"
        texts.append(" ".join(near))
    texts += [None, None, "", " \n\t ", "one", "One", "a b c", "...!!", "###", "Ñandú éclair straße"]
    texts += [words(2, 4000), words(3, 60) + " " + PASSAGE + " " + words(4, 60), PASSAGE + words(5, 80), "Sh " * 700]
    texts += ["x\n" * 5 + words(6, 55) + "\n" + words(6, 55), "password=abcdef123 AKIA" + "Q" * 17 + " " + "0f" * 14]
    rows = [(n, t, ("en", "fr", None)[n % 3], ("s1", "s2", None)[n % 3], len(t or "")) for n, t in enumerate(texts)]
    return rows + [rows[4], (None, "null id text", "en", "s1", 12), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return with_clashes(spark.createDataFrame(documents(), DOCS).repartition(3))


def with_clashes(df):
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_archive_round_trip(spark, nothing):
    html = ["", None, "<p>" + "x" * 200, "<p>" + "x" * 200, "short", "short", "a\r\n\r\nWARC-Type: evil\r\n" + "y" * 100, "é" * 60]
    rows = [(n, f"http://h/{n}" if n % 2 else None, h) for n, h in enumerate(html)]
    rows += [(9, "http://h/\r\nWARC-Type: revisit", "é" * 60), (None, "u", "é" * 60), (2, "again", "<p>" + "x" * 200)]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    folder = shared_folder(spark, "test")
    warc.write_archive(pages, folder)
    back = warc.read_archive(spark, folder).collect()
    assert spark.read.parquet(f"{folder}/payloads").count() == len({h or "" for _, _, h in rows})
    assert Counter((r.page_id, bytes(r.payload)) for r in back) == Counter((i, (h or "").encode()) for i, _, h in rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for r in back:
        text = bytes(r.payload).decode()
        revisit = r.page_id is not None and len(r.payload) >= 100 and r.page_id != first[text]
        assert (r.record_type, r.refers_to) == (("revisit", first[text]) if revisit else ("response", None))
        assert r.payload_digest == hashlib.sha256(r.payload).hexdigest() and r.payload_bytes == len(r.payload)
        head = bytes(r.header)
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and head.endswith(b"\r\n\r\n")
        assert bytes(r.record) == head + (b"" if revisit else bytes(r.payload))
    folder = shared_folder(spark, "test")
    warc.write_archive(pages.limit(0), folder)
    assert warc.read_archive(spark, folder).count() == 0


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_sharding(docs, nothing, shards):
    rows = sharding.shard_documents(docs, shards=shards, vnodes=8).collect()
    assert len(rows) == len(documents())
    loads = Counter(r.shard for r in rows)
    assert max(loads.values()) - min(loads[s] for s in range(shards)) <= 1
    for shard in loads:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(loads[shard]))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in documents())
    assert sharding.shard_documents(nothing, shards=shards, vnodes=8).count() == 0


def test_sharding_moves_little(spark):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    eight, nine = ({r.doc_id: r.shard for r in sharding.shard_documents(keys, shards=s).collect()} for s in (8, 9))
    moved = sum(eight[k] != nine[k] for k in eight) / len(eight)
    assert moved < 0.5  # hashing modulo the number of shards would move 8 / 9


def test_languages(spark, docs, nothing):
    sample = [(f"the and of {words(n, 40)} with the", "en") for n in range(40)] + [(f"ñandú él año {words(n, 40)} señor ñ", "es") for n in range(40)]
    model = langid.fit(sample)
    assert model.predict("the and with of") [0] == "en" and model.predict("señor año ñandú")[0] == "es"
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(documents())
    texts = {d: t for d, t, *_ in documents()}
    for r in rows:
        letters = any(c.isalpha() for c in texts[r.doc_id] or "") if r.doc_id is not None else True
        assert 0 <= r.score <= 1 and (letters or (r.lang_pred, r.score) == ("und", 0.0))
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(nothing).count() == 0
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for _, t, *_ in documents())


def test_languages_held_out(spark):
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(sample).join(sample.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert rows.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_languages_reject_noise_and_unknown_languages(spark):
    """The stage rejects by the model's score; clean documents, also held-out and short ones, pass."""
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    dice = random.Random(9)
    noise = ["".join(dice.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(size)) for size in (200, 1000, 5000, 70_000)]
    unknown = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, "
        "ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны "
        "поступать в отношении друг друга в духе братства."]
    bad = [(-1 - n, t, None) for n, t in enumerate(noise + unknown + ["### x 12 %% 34", "q"])]
    kept = {r.doc_id for r in langid.keep_identified(sample.unionByName(spark.createDataFrame(bad, sample.schema))).collect()}
    assert not [i for i in kept if i < 0]
    assert len(kept) >= 0.99 * sample.count()
    # without a label nothing can be rejected but what has no letter
    blank = spark.createDataFrame(bad + [(1, "12 %%", None)], sample.schema)
    assert langid.keep_identified(blank).count() == len(bad)


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("block_bytes", [50, 10_000])
def test_contamination(spark, docs, nothing, block_bytes):
    items = [(1, PASSAGE), (2, "one"), (3, None), (4, ""), (None, words(2, 14)), (11, "a B c"), (10, "a b c!"), (1, PASSAGE)]
    bench = with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    patterns = {}
    for item, text in items:
        w = word_list(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            patterns.setdefault(tuple(w[i:i + size]), set()).add(item)
    expected = []
    for doc_id, text, *_ in documents():
        w, hit, found = word_list(text), set(), set()
        for size in {len(p) for p in patterns}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in patterns:
                    hit.update(range(i, i + size))
                    found |= patterns[tuple(w[i:i + size])]
        names = sorted(str(i) for i in found if i is not None)
        expected.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    found = decontaminate.contamination_digest(decontaminate.contamination(docs, bench, block_bytes=block_bytes))
    assert sorted_rows(found) == sorted(expected, key=repr)
    kept = decontaminate.drop_contaminated(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns and kept.count() == sum(not e[-1] for e in expected)
    assert not decontaminate.contamination_digest(decontaminate.contamination(docs, bench.limit(0))).filter("contaminated").count()
    assert decontaminate.contamination(nothing, bench).count() == 0


def test_urls(spark):
    rows = [(1, "http://a.net/x", None), (2, "http://A.Example.NET/en/x?q", None), (3, "no scheme", ""), (4, None, None),
            (5, "http://shop.example.com/de/1", '<a href="http://bad.com/">'), (6, "http://bad.com/", "<a href='//shop.example.com/'>"),
            (7, "http://fine.org/fr/", '<A HREF=http://friend.com/x>'), (8, "http://friend.com", "<a href='/own'>"), (9, "http://net?x", ""), (9, "http://net?x", "")]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages).collect()}
    assert found == {
        1: ("a.net", "/x", "net/", "block"), 2: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("shop.example.com", "/de/1", "example.com/de/", "block"),
        6: ("bad.com", "/", None, "block"), 7: ("fine.org", "/fr/", "org/fr/", "allow"), 8: ("friend.com", "", None, "allow"),
        9: ("net", "", None, "allow")}
    assert urlfilter.judge_urls(pages).count() == len(rows) and urlfilter.judge_urls(pages.limit(0)).count() == 0


def test_ranks_on_a_graph_with_long_chains(spark):
    """Verdicts equal ranks by plain matrix products; hosts 24 hops from the only blocked one are found, and without links nothing is."""
    import numpy as np

    dice = random.Random(12)
    hosts = ["evil.net", *[f"far{n}.com" for n in range(24)], *[f"h{n}.com" for n in range(12)], "good.org"]
    links = [(n + 1, n) for n in range(24)] + [(dice.randrange(25, 38), dice.randrange(25, 38)) for _ in range(40)] + [(37, 26), (30, 3)]
    html = {n: "".join(f'<a href="http://{hosts[b]}/">' for a, b in links if a == n) for n in range(len(hosts))}
    rows = [(n, f"http://{h}/{'fr/' if h == 'good.org' else ''}", html[n]) for n, h in enumerate(hosts)]
    found = {r.page_id: r.verdict for r in urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), tolerance=1e-3).collect()}
    edges = np.zeros((len(hosts),) * 2)
    for a, b in links:
        if a != b:
            edges[a, b] += 1
    scores = []
    for matrix, seed in ((edges, 37), (edges.T, 0)):
        share = matrix / np.maximum(matrix.sum(1, keepdims=True), 1)
        part = total = 0.15 * np.eye(len(hosts))[seed]
        while part.sum() >= 1e-3:
            part = 0.85 * part @ share
            total = total + part
        scores.append(total)
    trust, distrust = scores
    expected = {n: "block" if distrust[n] > 0.5 * (trust[n] + distrust[n]) else "allow" for n in range(len(hosts))}
    expected |= {0: "block", 37: "allow"}
    assert found == expected and found[24] == "block"
    bare = spark.createDataFrame([(n, u, None) for n, u, _ in rows], "page_id long, url string, html string")
    assert {r.page_id for r in urlfilter.judge_urls(bare).collect() if r.verdict == "block"} == {0}


def sets_of(rows):
    found = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        found.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    return found


def components_of(rows):
    """Smallest doc_id that each row reaches over links, by comparing every pair."""
    sets, label = sets_of(rows), list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            label = [label[a] if x == label[b] else x for x in label]
    return [min((rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]


def test_near_duplicates(spark, docs, nothing):
    rows = documents()
    expected = [(r[0], len(s), c, c == r[0]) for r, s, c in zip(rows, sets_of(rows), components_of(rows))]
    assert sorted_rows(neardup.near_duplicates(docs)) == sorted(expected, key=repr)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == sum(e[3] for e in expected)
    assert neardup.near_duplicates(nothing).count() == 0


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    """Null and repeated ids: copies and near copies of null-id rows, repeats of a row, and an id shared by two texts."""
    named, unnamed, repeated, clean = (words(seed, 120) for seed in (21, 22, 23, 24))
    near = " ".join(["changed", *unnamed.split()[1:]])
    rows = [(5, named), (None, named), (None, unnamed), (None, unnamed), (None, near), (7, repeated), (7, repeated), (5, clean), (9, named),
            (None, ""), (None, None), (9, None)]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, row long").repartition(3)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    some = [t for t in (unnamed, near) if found[None, t]]
    assert len(some) == 1
    assert found == Counter([(5, named), (None, some[0]), (7, repeated), (5, clean), (None, ""), (None, None), (9, None)])
    assert {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()} == {
        (5, 5, True), (None, 5, False), (None, None, True), (7, 7, True), (9, 5, False), (9, 9, True)}


def test_near_duplicates_close_to_the_threshold(spark):
    """A large group of heavily edited copies, and chains whose ends are not similar."""
    dice, base, rows = random.Random(7), words(11, 90).split(), []
    for n in range(90):
        text = list(base)
        for at in dice.sample(range(90), dice.randint(1, 4)):
            text[at] = f"edit{n}x{at}"
        rows.append((n, " ".join(text)))
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == dict(zip((r[0] for r in rows), components_of(rows)))


def test_filters_never_drop_a_pair_above_the_threshold():
    dice = random.Random(3)
    for _ in range(200):
        x = {dice.getrandbits(40) for _ in range(300)}
        y = set(list(x)[: dice.randint(265, 300)]) | {dice.getrandbits(40) for _ in range(dice.randint(0, 30))}
        if 100 * len(x & y) < 75 * len(x | y):
            continue
        import numpy as np
        a, b = (np.array(sorted(s), dtype=np.uint64) for s in (x, y))
        unequal = sum(int(v).bit_count() for v in (neardup.parity_bits(a) ^ neardup.parity_bits(b)).view(np.uint64))
        assert unequal * 175 <= (len(x) + len(y)) * 25


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (4, 9), (9, 0), (11, 11)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 0, 2: 0, 3: 0, 4: 0, 9: 0, 0: 0, 10: 10, 11: 10}


def removed_by_hand(rows):
    """Cut every byte covered by a 400-byte string that starts twice."""
    size, seen, expected = suffixes.LENGTH, Counter(), []
    data = [(t or "").encode() for _, t, *_ in rows]
    for d in data:
        seen.update(d[i:i + size] for i in range(len(d) - size + 1))
    for row, d in zip(rows, data):
        mask = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[d[i:i + size]] > 1:
                mask[i:i + size] = b"\1" * size
        kept = bytes(b for b, m in zip(d, mask) if not m)
        runs = sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))
        expected.append((row[0], len(d), sum(mask), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(expected, key=repr)


@pytest.mark.parametrize("limit", [1, 4096])
def test_repeated_strings(spark, docs, nothing, limit, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP_LIMIT", limit)
    monkeypatch.setattr(suffixes, "SEGMENT", 1500)
    found = suffixes.removal_digest(suffixes.remove_repeats(docs))
    assert sorted_rows(found) == removed_by_hand(documents())
    assert suffixes.removal_digest(suffixes.remove_repeats(nothing)).count() == 0


def test_deep_shallow_order():
    dice = random.Random(1)
    for _ in range(100):
        base = bytes(dice.choice(b"ab") for _ in range(200))
        strings = [base[:dice.randint(0, 200)] + bytes(dice.choice(b"abc") for _ in range(dice.randint(0, 30))) for _ in range(dice.randint(2, 40))]
        order, shared = suffixes.deep_shallow(strings)
        assert [strings[i] for i in order] == sorted(strings)
        assert shared == [suffixes.common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]


def test_secrets(spark, docs, nothing):
    dice = random.Random(2)
    samples = (["".join(dice.choice("0123456789abcdefABCDEFXYZ") for _ in range(32)) for _ in range(200)], words(8, 3000).split())
    ratio = secrets.log_ratio(*samples)
    token = "".join(dice.choice("0123456789abcdefABCDEFXYZ") for _ in range(30))
    assert [s[0] for s in secrets.all_spans(f"see {token} here", ratio)] == ["markov"]
    assert secrets.all_spans("thisisaverylongordinarywordindeed", ratio) == []
    text = 'é PassWord : "ab/c.d=" secret:token:abcdef AKIA' + "B" * 16 + " " + "0a" * 12 + " token=abc"
    spans = [(k, text[a:b]) for k, a, b in secrets.all_spans(text, None)]
    assert spans == [("assign", 'PassWord : "ab/c.d='), ("access", "AKIA" + "B" * 16), ("hex", "0a" * 12)]
    assert secrets.all_spans("api_key=api-key paſſword=abcdefg", None) == [("assign", 0, 15)]
    found = secrets.secret_digest(secrets.find_secrets(docs))
    assert found.count() == len(documents()) and found.agg(F.sum("n_assign"), F.sum("n_access"), F.sum("n_hex")).first() == (1, 1, 1)
    empty = hashlib.sha256(b"").hexdigest()
    assert found.filter((F.col("n_assign") == 0) & (F.col("base_sha256") != empty)).count() == 0
    masked = secrets.mask_secrets(docs)
    assert masked.columns == docs.columns
    assert sum("abcdef123" in (r.text or "") for r in masked.collect()) == 0
    assert masked.filter("n_chars <> char_length(text)").count() == 0
    assert secrets.find_secrets(nothing).count() == 0 and secrets.mask_secrets(nothing).count() == 0


@pytest.mark.parametrize("place", ["outside the pool", "null id", "late in a text"])
def test_rare_secrets_train_the_model(spark, monkeypatch, place):
    """One base match in a table larger than the pool, or where the first characters do not show it."""
    monkeypatch.setattr(secrets, "POOL_ROWS", 5)
    ids = sorted(range(200), key=lambda n: hashlib.md5(str(n).encode()).hexdigest())
    value = "0f1e2d3c4b5a69788796a5b4c3d2e1f0"
    rows = [(n, words(n, 20)) for n in ids]
    rows[0 if place == "late in a text" else -1] = (
        None if place == "null id" else ids[0 if place == "late in a text" else -1], words(1, 20_000 if place == "late in a text" else 5) + " " + value)
    found = secrets.training_sample(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found[0] == [value] and secrets.log_ratio(*found) is not None


def test_packing(spark, docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["İstanbul ΣΑΣ ﬁ ½ x1\x1fy áb", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "don't.. a.b,c 12,345. ÉCLAIR,"]
    more = spark.createDataFrame([(1000 + n, t) for n, t in enumerate(odd)], "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    capacity = 512
    rows = packing.pack_documents(both, path, capacity).collect()
    tokenizer = Tokenizer.from_file(path)
    expected = Counter()
    for doc_id, text in [(d, t) for d, t, *_ in documents()] + [(1000 + n, t) for n, t in enumerate(odd)]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            expected[doc_id, piece, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    # many pieces here are longer than half a sequence, so the lower bound itself is out of reach
    assert len(sequences) <= 1.15 * sum(r.length for r in rows) / capacity
    assert packing.pack_documents(nothing, path).count() == 0


def test_grouping_genetic_algorithm_improves_on_best_fit():
    dice = random.Random(4)
    lengths = [size for _ in range(40) for size in (lambda a, b: (a, b, 100 - a - b))(dice.randint(20, 40), dice.randint(20, 35))]
    start = packing.Packing(lengths, 100)
    plain = start.best_fit(start.decreasing(list(range(len(lengths)))))
    best = packing.evolve(lengths, 100, 1, [])
    best = packing.evolve(lengths, 100, 2, [best.bins])
    assert sorted(i for b in best.bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in best.bins) and len(best.bins) <= len(plain.bins)


def test_quality(docs, nothing):
    expected = []
    for doc_id, text, *_ in documents():
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        triples = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        repeat = {j for i in range(len(w) - 2) if triples[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        expected.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), failed))
    found = quality.quality_rules(docs)
    assert sorted_rows(found.drop("kept")) == sorted(expected, key=repr)
    assert found.filter("base_failed and kept").count() == 0
    assert quality.quality_rules(nothing).count() == 0


def test_host_rates(spark):
    rows = [(n, h, f) for h, bad, size in (("good", 1, 40), ("bad", 38, 40), ("small", 1, 1)) for n, f in enumerate([True] * bad + [False] * (size - bad))]
    hosts = {r.host: r for r in quality.host_verdicts(spark.createDataFrame(rows, "doc_id long, host string, base_failed boolean")).collect()}
    assert hosts["good"].host_kept and not hosts["bad"].host_kept
    assert hosts["small"].rate < 1 and hosts["bad"].rate < 38 / 40


def test_pipeline(spark, docs):
    """Each stage against what its own input must lose."""
    folder = "/root/testdata/sf0.001"
    current = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        before = [tuple(r) for r in current.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        path = shared_folder(spark, name)
        function(spark, current, folder).write.parquet(path)
        current = spark.read.parquet(path)
        kept[name] = before, current
    before, after = kept["language_id"]
    assert {r.doc_id for r in after.collect()} == {r[0] for r in before if any(c.isalpha() for c in r[1])}
    before, after = kept["near_duplicates"]
    assert {r.doc_id for r in after.collect()} == {r[0] for r, c in zip(before, components_of(before)) if r[0] == c}
    before, after = kept["decontamination"]
    windows = set()
    for (text,) in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect():
        w = word_list(text)
        windows |= {tuple(w[i:i + 10]) for i in range(len(w) - 9)}
    clean = {r[0] for r in before if not any(tuple(word_list(r[1])[i:i + 10]) in windows for i in range(len(word_list(r[1])) - 9))}
    assert {r.doc_id for r in after.collect()} == clean and len(clean) < len(before)
    before, after = kept["secret_scans"]
    assert after.count() == len(before) and after.columns[:2] == ["doc_id", "text"]
    assert not any(secrets.base_spans(r.text.replace(secrets.MASK, " ")) for r in after.collect())
    before, after = kept["packing"]
    assert {r.doc_id for r in after.collect()} == {r[0] for r in before}


def test_words_that_collide_under_polynomial_hashes_stay_apart(spark):
    """Thue-Morse words and their complements collide modulo 2^64 for every odd base from 1,024 letters on."""
    for bits in (10, 11, 12):
        one = "".join("ab"[n.bit_count() % 2] for n in range(1 << bits))
        other = one.translate(str.maketrans("ab", "ba"))
        assert neardup.shingle_set(one) != neardup.shingle_set(other)
        rows = spark.createDataFrame([(1, one), (2, other), (3, one.upper())], "doc_id long, text string")
        found = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(rows).collect()} if bits == 10 else None
        assert found in (None, {1: (1, True), 2: (2, True), 3: (1, False)})
