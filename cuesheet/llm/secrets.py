"""Secret scans: fixed patterns, and character Markov models of random strings against identifiers.

Three kinds of base spans come from patterns. Two first-order Markov models over characters are
trained from labelled samples: the values of base matches are random strings, the other long
tokens of the same texts are ordinary. A token is a further span of kind ``markov`` if its
log-likelihood ratio, in total and per step, is high and it touches no base span.

The sample is bounded: of about POOL_ROWS rows with the lowest hash of doc_id, ``sample_rows`` texts that hold a base
match and as many others, in the order of that hash, ``sample_chars`` characters of each. If these hold fewer than
``FEW`` base matches, the matches of all whole texts take their place, of ``sample_rows`` texts in the same order (null ids last),
so the method is off only if no text has a match. All whole texts, very long ones too, are scanned one by one; an empty table gives no rows.

Defined results: a null text is empty. Spans count code points, end exclusive, and cover the whole
match. Without labelled random strings no markov span is added. Repeated rows are judged one by
one; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuesheet.llm.common import map_batches

KINDS = ("assign", "access", "hex", "markov")
SAMPLE_ROWS, SAMPLE_CHARS, MIN_TOKEN, MIN_RATIO, MIN_STEP = 500, 50_000, 20, 20.0, 0.7
POOL_ROWS, FEW = 20_000, 50
MASK = "[SECRET]"

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}")
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HINT = r"""AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""

_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_CODE = np.full(128, len(_CHARS), dtype=np.int64)
_CODE[[ord(c) for c in _CHARS]] = np.arange(len(_CHARS))


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the pattern matches, by start and then kind."""
    found = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _steps(token: str) -> tuple[np.ndarray, np.ndarray]:
    codes = _CODE[np.frombuffer(token.encode("ascii", "replace"), dtype=np.uint8) & 127]
    return codes[:-1], codes[1:]


def log_ratio(random: list[str], ordinary: list[str]) -> np.ndarray | None:
    """log P(next | previous) under random strings minus that under ordinary ones, add-one smoothed."""
    if not random or not ordinary:
        return None
    logs = []
    for sample in (random, ordinary):
        counts = np.ones((len(_CHARS) + 1,) * 2)
        for token in sample:
            np.add.at(counts, _steps(token), 1)
        logs.append(np.log(counts / counts.sum(1, keepdims=True)))
    return logs[0] - logs[1]


def _tokens(text: str) -> tuple[list[str], list[str]]:
    """Values of base matches, and the other tokens."""
    spans = base_spans(text)
    taken = bytearray(len(text))
    for _, first, after, _ in spans:
        taken[first:after] = b"\1" * (after - first)
    return [s[3] for s in spans], [m[0] for m in ORDINARY.finditer(text) if not any(taken[m.start():m.end()])]


def _everywhere(docs: DataFrame, sample_rows: int, sample_chars: int) -> tuple[list[str], list[str]]:
    """The tokens of ``sample_rows`` texts that have a base match anywhere, ``sample_chars`` characters of each kind of token."""
    def bounded(tokens: list[str]) -> list[str]:
        found, room = [], sample_chars
        for token in tokens:
            found.append(token[:room])
            room -= len(token)
            if room <= 0:
                break
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.string())
        for batch in batches:
            found = [(o, *map(bounded, _tokens(t))) for o, t in zip(batch.column("order").to_pylist(), batch.column("text").to_pylist())]
            found = [x for x in found if x[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], kind), pa.array([x[2] for x in found], kind)],
                names=["order", "random", "ordinary"])

    rows = docs.select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("order"), "text").filter(F.col("text").rlike(_HINT))
    rows = map_batches(rows, run, "order string, random array<string>, ordinary array<string>")
    rows = rows.orderBy(F.col("order").asc_nulls_last(), "random", "ordinary").limit(sample_rows).collect()
    return [t for r in rows for t in r["random"]], [t for r in rows for t in r["ordinary"]]


def training_sample(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """Values of base matches, and other tokens, from a bounded sample of texts, drawn from about ``POOL_ROWS`` rows."""
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    share = F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / float(1 << 32)
    pool = docs.filter(share * max(1, docs.count()) < POOL_ROWS)
    rows = pool.select("doc_id", order.alias("order"), F.col("text").rlike(_HINT).alias("hint")).filter("hint is not null")
    ids = rows.filter("hint").orderBy("order").limit(sample_rows).unionByName(
        rows.filter("not hint").orderBy("order").limit(sample_rows)).select(F.col("doc_id").alias("id"))
    # the ids' number is bounded by the parameter
    texts = docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), F.col("doc_id") == F.col("id")).select(
        F.substring("text", 1, sample_chars).alias("start"), order.alias("order"))
    random, ordinary = [], []
    for (text, _) in texts.filter("start is not null").orderBy("order", "start").limit(2 * sample_rows).collect():
        for found, more in zip((random, ordinary), _tokens(text)):
            found += more
    if len(random) < FEW:
        random, more = _everywhere(docs, sample_rows, sample_chars)
        ordinary = ordinary or more
    return random, ordinary


def all_spans(text: str | None, ratio: np.ndarray | None) -> list[tuple[str, int, int]]:
    if not text:
        return []
    base = base_spans(text)
    found = [s[:3] for s in base]
    if ratio is not None:
        for match in TOKEN.finditer(text):
            first, after = match.span()
            if any(s[1] < after and first < s[2] for s in base):
                continue
            steps = ratio[_steps(match[0])]
            if steps.sum() >= MIN_RATIO and steps.mean() >= MIN_STEP:
                found.append(("markov", first, after))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, samples: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """(doc_id, found): the spans of each text in order, found being array<struct<kind, start, end>>."""
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(*(samples or training_sample(docs))))
    fields = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in all_spans(t, ratio.value)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, fields)], names=["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, run, "doc_id long, found array<struct<kind: string, start: long, end: long>>")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the span lists of the contract."""
    def listed(condition=None):
        spans = F.filter("found", condition) if condition else F.col("found")
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(listed(lambda s: s["kind"] != "markov").cast("binary"), 256).alias("base_sha256"), listed().alias("spans"),
    )


def mask_text(text: str | None, ratio: np.ndarray | None) -> str | None:
    """The text with each found span, overlapping ones as one, replaced by a mask."""
    if not text:
        return text
    parts, done = [], 0
    for _, first, after in all_spans(text, ratio):
        if first >= done:
            parts += [text[done:first], MASK]
        done = max(done, after)
    return "".join(parts) + text[done:] if parts else text


def mask_secrets(docs: DataFrame, samples: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """All rows and columns, with secrets masked in ``text`` and ``n_chars`` counted again where there is one."""
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(*(samples or training_sample(docs))))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [mask_text(t, ratio.value) for t in batch.column("text").to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    masked = map_batches(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return masked
