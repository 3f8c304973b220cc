"""Language identification with a blended-spectrum string kernel.

Two blocks of text are as alike as the character n-grams (n = 1, 2, 3) that both contain: the kernel
counts shared grams, presence only, and is normalised. Landmark blocks give Nystrom features
k(x, L) K_LL^(-1/2); one-versus-rest kernel ridge regression on those features learns one
function per language. Since a block is a 0/1 vector x over grams, all languages' scores are the
matrix product x B / |x|, with B made once from landmarks and coefficients, for batches of blocks.

Every whole text is scored: it is cut into blocks so that long and mixed texts do not fill
the gram set, and block scores are averaged by length. Learning uses a bounded sample: at most
``per_language`` documents of each language, ``sample_rows`` in all, in the order of a hash of doc_id,
and ``sample_chars`` characters of each.

``keep_identified`` rejects by the model's own score. Every fourth text of each language in the sample
stays out of the fit; those texts and their beginnings show how low the best score of clean text falls, by the number of
distinct grams that a block has. A text is rejected if its best score is below ``REJECT``, or, where clean text of as few grams
falls lower, below the ``LOWEST`` share of that clean text less ``SLACK``. Fewer than ``MIN_GRAMS`` distinct grams (one letter)
name no language. So long noise and unknown languages go; of a few words only what scores below clean
text of that size goes. If no text can stay out of the fit (no language with four texts), all texts with a letter are kept.

Defined results: ``und`` with score 0 for a null text or one without letters, and for all texts if
nothing could be learned. A null doc_id is never learned from and is not held out. Equal scores go to
the first language in text order. Very long texts are scored whole, block by block; an empty table gives no rows. Repeated rows are judged one by one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cuesheet.llm.common import map_batches

SLOT_BITS, BLOCK, ORDERS = 14, 1024, 3
PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_CHARS, LANDMARKS, RIDGE = 300, 3000, 8192, 256, 0.3
MAX_LANGUAGES = 500
REJECT, LOWEST, SLACK, MIN_GRAMS, HOLD_BACK = 0.05, 0.005, 0.05, 4, 4
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters; lone surrogates and others are not."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=np.bool_)


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points; each run of other characters is one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, points, np.uint32(32))[keep]


def gram_presence(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0/1 rows over hashed grams for each block of one text, and the blocks' lengths."""
    count = max(1, -(-len(codes) // BLOCK))
    present = np.zeros((count, 1 << SLOT_BITS), dtype=np.uint8)
    rows = np.arange(len(codes)) // BLOCK
    value = np.zeros(len(codes), dtype=np.uint64)
    wide = codes.astype(np.uint64)
    for order in range(1, ORDERS + 1):
        if len(codes) < order:
            break
        value = value[:len(codes) - order + 1] * np.uint64(0x110003) + wide[order - 1:] + np.uint64(order)
        slots = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)
        present[rows[:len(slots)], slots.astype(np.int64)] = 1
    return present, np.bincount(rows, minlength=count)


@dataclass
class KernelModel:
    languages: list[str]
    weights: np.ndarray  # (grams, languages)
    limits: tuple[float, ...] = ()  # least best score by bit length of the gram count; empty without calibration

    def judge(self, codes: np.ndarray) -> tuple[np.ndarray, float]:
        """The mean score per language and the mean number of distinct grams over the blocks of some letters."""
        total, grams = np.zeros(len(self.languages)), 0.0
        for first in range(0, len(codes), 64 * BLOCK):
            present, lengths = gram_presence(codes[first:first + 64 * BLOCK])
            sizes = present.sum(1, dtype=np.int64)
            norm = np.sqrt(np.maximum(sizes, 1))
            total += ((present.astype(np.float32) @ self.weights) / norm[:, None] * lengths[:, None]).sum(0)
            grams += float((sizes * lengths).sum())
        return total / len(codes), grams / len(codes)

    def scores(self, text: str | None) -> np.ndarray | None:
        """One mean score per language, or None where there is no letter or no model."""
        if not text or not self.languages:
            return None
        codes = _codes(text)
        return self.judge(codes)[0] if len(codes) else None

    def recognises(self, text: str | None) -> bool:
        """Whether a text has letters and its best score is not below the limit for its number of grams."""
        codes = _codes(text or "")
        if not len(codes) or not self.limits:
            return len(codes) > 0
        scores, grams = self.judge(codes)
        return grams >= MIN_GRAMS and bool(scores.max() >= self.limits[min(int(grams).bit_length(), len(self.limits) - 1)])

    def predict(self, text: str | None) -> tuple[str, float]:
        scores = self.scores(text)
        if scores is None:
            return UNKNOWN, 0.0
        share = np.exp(4 * (scores - scores.max()))
        best = int(scores.argmax())
        return self.languages[best], float(share[best] / share.sum())


def fit(samples: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """Train on (text, language) pairs in the given order; landmarks are taken evenly from their blocks."""
    blocks, answers = [], []
    for text, language in samples:
        codes = _codes(text)
        if len(codes):
            present, _ = gram_presence(codes)
            blocks.append(present[: max(1, len(present) - 1)])
            answers += [language] * len(blocks[-1])
    languages = sorted(set(answers))
    if not languages:
        return KernelModel([], np.zeros((1 << SLOT_BITS, 0), dtype=np.float32))
    x = np.concatenate(blocks)
    chosen = np.unique(np.linspace(0, len(x) - 1, min(landmarks, len(x))).astype(int))

    def unit(rows: np.ndarray) -> np.ndarray:
        return rows.astype(np.float32) / np.sqrt(np.maximum(rows.sum(1, dtype=np.int64), 1))[:, None].astype(np.float32)

    marks = unit(x[chosen])
    gram = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate([unit(x[i:i + 512]) @ marks.T for i in range(0, len(x), 512)]).astype(np.float64) @ root
    target = np.where(np.array(answers)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    inner = features.T @ features + ridge * np.eye(features.shape[1])
    weights = marks.T.astype(np.float64) @ (root @ np.linalg.solve(inner, features.T @ target))
    return KernelModel(languages, weights.astype(np.float32))


def fit_with_limits(samples: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """A model of all texts but every ``HOLD_BACK``-th of each language, with score limits from those that it has not seen."""
    seen: dict[str, int] = {}
    learned, clean = [], []
    for text, language in samples:
        seen[language] = seen.get(language, 0) + 1
        (learned if seen[language] % HOLD_BACK else clean).append((text, language))
    model = fit(learned, landmarks, ridge)
    best: dict[int, list[float]] = {}
    for text, _ in clean if model.languages else ():
        codes = _codes(text)
        # the whole text and its beginnings, so that there is clean text of every size
        for size in {min(len(codes), 1 << power) for power in range(2, 31)} - {0}:
            scores, grams = model.judge(codes[:size])
            best.setdefault(int(grams).bit_length(), []).append(float(scores.max()))
    if not best:
        return model
    limits = []
    for power in range(max(best) + 1):
        low = sorted(best.get(power, []))
        # sizes that no clean text has take the limit of the next smaller one
        limits.append(min(REJECT, low[int(LOWEST * len(low))] - SLACK) if low else limits[-1] if limits else -np.inf)
    # more grams never lower the limit
    return replace(model, limits=tuple(float(x) for x in np.minimum.accumulate(limits[::-1])[::-1]))


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(
    docs: DataFrame, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS
) -> list[tuple[str, str]]:
    """At most ``sample_rows`` (text, lang) pairs. Only ids are ranked, and only those whose hash is low enough for
    their language's count, so no texts are shuffled and no task ranks more than a few times ``per_language``."""
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    ids = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out()).select(
        F.col("doc_id").alias("id"), F.col("lang").alias("language"), order.alias("order"))
    # the most frequent languages, a bounded number of rows
    counts = ids.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(MAX_LANGUAGES)
    share = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / float(1 << 32)
    drawn = ids.join(F.broadcast(counts), "language").filter(share * F.col("n") < 4 * per_language)
    ranked = drawn.withColumn("rank", F.row_number().over(W.partitionBy("language").orderBy("order"))).filter(F.col("rank") <= per_language)
    chosen = ranked.orderBy("rank", "order").limit(sample_rows).select("id", "rank", "order")
    texts = docs.select("doc_id", F.substring("text", 1, sample_chars).alias("start"), "lang").filter("lang is not null")
    # the ids' number is bounded by sample_rows
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).filter("start is not null") \
        .orderBy("rank", "order", "lang", "start").limit(sample_rows).select("start", "lang").collect()
    return [(r[0], r[1]) for r in rows]


def identify(docs: DataFrame, model: KernelModel | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; trains first if no model is given."""
    model = model or fit(training_sample(docs))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            guesses = [sent.value.predict(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"),
                pa.array([g[0] for g in guesses], pa.string()), pa.array([g[1] for g in guesses], pa.float64()),
            ], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), "text")
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: KernelModel | None = None) -> DataFrame:
    """The rows whose text the model recognises, all columns as they came. A model without limits rejects
    only texts without letters."""
    model = model or fit_with_limits(training_sample(docs))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [sent.value.recognises(text) for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, docs.schema)
