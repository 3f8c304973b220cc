"""Secret scans and language scores against a second computation: hand-written scanners, counted character pairs, and
kernels of gram sets instead of matrix products."""

from __future__ import annotations

import hashlib
import math
import os
import random
import string
from collections import Counter

import numpy as np
import pytest

from cuesheet.llm import langid, secrets

SF_DIR = "/root/testdata/sf0.001"
LETTERS = string.ascii_letters + string.digits
VALUE, TOKEN = set(LETTERS + "+/_.=-"), set(LETTERS + "+/_=-")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ORDER = ("assign", "access", "hex", "markov")


def runs(text, allowed, start=0):
    """Maximal runs of allowed characters as (start, end)."""
    while start < len(text):
        end = start
        while end < len(text) and text[end] in allowed:
            end += 1
        if end > start:
            yield start, end
        start = max(end, start + 1)


def plain_case(text):
    return "".join(c.lower() if c in string.ascii_uppercase else c for c in text)


def assigned(text):
    """(start, end, value) of each leftmost assignment; a search goes on after every match, short values included."""
    low, at = plain_case(text), 0
    while at < len(text):
        name = next((n for n in NAMES if low.startswith(n, at)), None)
        end = None
        if name:
            here = at + len(name)
            here += text[here:here + 1] in ('"', "'")
            while text[here:here + 1] == " ":
                here += 1
            if text[here:here + 1] in (":", "="):
                here += 1
                while text[here:here + 1] == " ":
                    here += 1
                here += text[here:here + 1] in ('"', "'")
                if here < len(text) and text[here] in VALUE:
                    end = next(runs(text, VALUE, here))[1]
        if end is None:
            at += 1
            continue
        if end - here >= 6:
            yield at, end, text[here:end]
        at = end


def accesses(text):
    at = text.find("AKIA")
    while at >= 0:
        end = next(e for s, e in runs(text, set(string.ascii_uppercase + string.digits), at))
        if end - at >= 20:
            yield at, end, text[at:end]
        # a match needs one character after the four; without it the search goes on one further
        at = text.find("AKIA", end if end - at > 4 else at + 1)


def base(text):
    found = [("assign", *s) for s in assigned(text)] + [("access", *s) for s in accesses(text)]
    found += [("hex", s, e, text[s:e]) for s, e in runs(text, set("0123456789abcdef")) if e - s >= 24]
    return sorted(found, key=lambda s: (s[1], ORDER.index(s[0])))


class Pairs:
    """Add-one estimates of the next character, over 68 characters and one for all others."""

    def __init__(self, tokens):
        self.pairs = Counter(pair for t in tokens for pair in zip(t, t[1:]))
        self.firsts = Counter(a for t in tokens for a in t[:-1])

    def log(self, a, b):
        return math.log((self.pairs[a, b] + 1) / (self.firsts[a] + len(VALUE) + 1))


def every_span(text, random_pairs, ordinary_pairs):
    found = [s[:3] for s in base(text)]
    for start, end in runs(text, TOKEN):
        if end - start < 20 or any(s < end and start < e for k, s, e in found if k != "markov"):
            continue
        steps = [random_pairs.log(a, b) - ordinary_pairs.log(a, b) for a, b in zip(text[start:end], text[start + 1:end])]
        if sum(steps) >= 20 and sum(steps) / len(steps) >= 0.7:
            found.append(("markov", start, end))
    return sorted(found, key=lambda s: (s[1], ORDER.index(s[0])))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_secret_spans_equal_a_second_computation(spark):
    dice = random.Random(9)
    planted = [
        f"é see {''.join(dice.choice(LETTERS) for _ in range(36))} and {'0f' * n} AKIAAKIA AKIA{'Q' * n}, "
        f"my_secret_token = 'abc' Token:x{n}yzabc APIKEY='api_key={'z' * n}' thisisaverylongordinarywordindeed"
        for n in range(8, 28)]
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    docs = documents.unionByName(spark.createDataFrame(
        [(10**9 + n, t) for n, t in enumerate([*planted, None, ""])], documents.schema))
    samples = secrets.training_sample(docs)
    models = [Pairs(tokens) for tokens in samples]
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    written = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    result, seen = secrets.secret_digest(secrets.find_secrets(docs, samples)).collect(), Counter()
    assert len(result) == len(texts)
    for row in result:
        plain, spans = [s[:3] for s in base(texts[row.doc_id])], every_span(texts[row.doc_id], *models)
        kinds = Counter(k for k, *_ in plain)
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(kinds[k] for k in ORDER[:3]), row.doc_id
        assert row.base_sha256 == hashlib.sha256(written(plain).encode()).hexdigest(), row.doc_id
        assert row.spans == written(spans), row.doc_id
        seen.update(k for k, *_ in spans)
    assert all(seen[k] for k in ORDER)


def gram_sets(text):
    """For each block of 1,024 characters its set of hashed grams that start there, and its length."""
    shown = "".join(c if c.isalpha() else " " for c in text.lower()).lstrip(" ")
    while "  " in shown:
        shown = shown.replace("  ", " ")
    blocks = []
    for first in range(0, len(shown), 1024):
        slots, length = set(), min(1024, len(shown) - first)
        for at in range(first, first + length):
            value = 0
            for order, char in enumerate(shown[at:at + 3], 1):
                value = (value * 0x110003 + ord(char) + order) % 2**64
                slots.add(value * 0x9E3779B97F4A7C15 % 2**64 >> 50)
        blocks.append((slots, length))
    return blocks


def likeness(left, right):
    return np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in right] for a in left])


def plain_scores(samples, asked, landmarks, ridge):
    """Mean score per language of each text: ridge regression on kernel values to landmarks, all in kernels."""
    blocks, answers = [], []
    for text, language in samples:
        sets = [slots for slots, _ in gram_sets(text)]
        sets = sets[:max(1, len(sets) - 1)]
        blocks, answers = blocks + sets, answers + [language] * len(sets)
    chosen = np.unique(np.linspace(0, len(blocks) - 1, min(landmarks, len(blocks))).astype(int))
    marks = [blocks[i] for i in chosen]
    left, sizes, right = np.linalg.svd(likeness(marks, marks))
    root = left[:, sizes > 1e-6 * sizes.max()] / np.sqrt(sizes[sizes > 1e-6 * sizes.max()])
    features = likeness(blocks, marks) @ root
    languages = sorted(set(answers))
    wanted = np.array([[1.0 if a == language else -1.0 for language in languages] for a in answers])
    inner = np.vstack([features, math.sqrt(ridge) * np.eye(features.shape[1])])
    learned = np.linalg.lstsq(inner, np.vstack([wanted, np.zeros((features.shape[1], len(languages)))]), rcond=None)[0]
    scores = []
    for text in asked:
        sets = gram_sets(text)
        values = likeness([slots for slots, _ in sets], marks) @ root @ learned
        scores.append(np.average(values, axis=0, weights=[length for _, length in sets]))
    return languages, scores


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_language_scores_equal_kernels_of_sets(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang")
    samples = langid.training_sample(docs, per_language=15, sample_chars=2500)
    assert len({language for _, language in samples}) > 1
    rows = docs.filter("text is not null").orderBy("doc_id").limit(60).collect()
    asked = [r.text for r in rows if any(c.isalpha() for c in r.text)] + ["é", "Ab, cd?! ef", "straße ﬁn " * 700]
    model = langid.fit(samples, landmarks=40)
    languages, expected = plain_scores(samples, asked, 40, langid.RIDGE)
    assert model.languages == languages
    for text, scores in zip(asked, expected):
        assert model.scores(text) == pytest.approx(scores, abs=2e-3)
        first, second = sorted(scores)[::-1][:2]
        if first - second > 0.01:
            assert model.predict(text)[0] == languages[int(np.argmax(scores))]
