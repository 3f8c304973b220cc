"""Fill-in-middle transformation over a learned index of code point boundaries.

A cut is drawn as a rank among a text's code points, while the text is bytes. ``RankIndex`` maps ranks to byte
offsets: segments of a piecewise linear function, fitted greedily so that no boundary offset is off by more than
``error`` bytes, and one signed byte of residual for each boundary. A look-up predicts by the segment that owns the
rank and adds the stored residual, which is exact. Texts are indexed in pieces of ``PIECE`` bytes, so beside the
text a worker holds one byte for each code point, and the offsets of one piece at a time.

Cuts and forms follow four unsigned integers, the first groups of eight hex digits of the SHA-256 of
``salt`` followed by the decimal doc_id: the two cuts are the first two modulo n + 1, the smaller one first; the third
decides between a plain and a cut text, the fourth between the orders suffix-first (spm) and prefix-first (psm).

Defined results: a null text is empty. Empty texts and texts that hold a sentinel stay plain. A null doc_id is hashed
as ``null``. Very long texts are cut whole. Rows are judged one by one, so repeated rows give repeated results; rows
with equal doc_id draw the same numbers. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuesheet.llm.common import map_batches

SALT, PLAIN_PERCENT, SPM_PERCENT = "1:", 10, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Largest prediction error in bytes; residuals are stored in one signed byte each.
ERROR = 64
#: Bytes indexed at once.
PIECE = 1 << 20


class RankIndex:
    """Byte offsets of the code point boundaries of UTF-8 data: ``count`` code points, boundaries 0 to ``count``."""

    def __init__(self, data: bytes, error: int = ERROR, piece: int = PIECE):
        if not 1 <= error <= 126:
            raise ValueError("error must leave room in a signed byte")
        values = np.frombuffer(data, dtype=np.uint8)
        ranks, offsets, slopes, residuals, count = [], [], [], [], 0
        for base in range(0, len(values), piece):
            part = values[base:base + piece]
            bounds = np.flatnonzero((part & 0xC0) != 0x80) + base
            at = 0
            while at < len(bounds):
                length, slope = _longest_segment(bounds, at, error)
                ranks.append(count + at)
                offsets.append(int(bounds[at]))
                slopes.append(slope)
                residuals.append((bounds[at:at + length] - _line(bounds[at], slope, np.arange(length))).astype(np.int8))
                at += length
            count += len(bounds)
        self.count, self.size = count, len(values)
        self.ranks, self.offsets, self.slopes = np.array(ranks, np.int64), np.array(offsets, np.int64), np.array(slopes)
        self.residuals = np.concatenate(residuals) if residuals else np.zeros(0, np.int8)

    def predict(self, rank: int) -> int:
        """The offset by the segment alone, at most ``error`` + 1 bytes off."""
        segment = int(np.searchsorted(self.ranks, rank, side="right")) - 1
        return int(_line(self.offsets[segment], self.slopes[segment], rank - self.ranks[segment]))

    def offset(self, rank: int) -> int:
        """The byte offset of boundary ``rank``."""
        if rank == self.count:
            return self.size
        return self.predict(rank) + int(self.residuals[rank])


def _line(offset, slope, steps):
    return offset + np.rint(slope * steps).astype(np.int64)


def _longest_segment(bounds: np.ndarray, first: int, error: int) -> tuple[int, float]:
    """(number of boundaries, slope) of the longest line from boundary ``first`` with no offset beyond ``error``.

    Every boundary allows a cone of slopes; the segment ends where the cones so far have no slope in common.
    Cones are cut in blocks that double, so a long segment takes few steps."""
    low, high, at, block = -np.inf, np.inf, first + 1, 64
    while at < len(bounds):
        part = bounds[at:at + block]
        steps = np.arange(at - first, at - first + len(part))
        rise = part - bounds[first]
        lows = np.maximum.accumulate(np.maximum((rise - error) / steps, low))
        highs = np.minimum.accumulate(np.minimum((rise + error) / steps, high))
        closed = np.flatnonzero(lows > highs)
        if len(closed):
            end = int(closed[0])
            if end:
                low, high = lows[end - 1], highs[end - 1]
            return at + end - first, float(low + high) / 2
        low, high, at, block = lows[-1], highs[-1], at + len(part), min(2 * block, 1 << 16)
    return len(bounds) - first, float(low + high) / 2 if len(bounds) - first > 1 else 0.0


def fill_in_middle(
    docs: DataFrame, salt: str = SALT, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT,
    sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row; the lengths are null for plain texts."""
    prefix, suffix, middle = sentinels
    marks = [s.encode() for s in (prefix, suffix, middle)]
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))).cast("binary"), 256)
    drawn = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), digest.alias("digest"))
    whole = (F.octet_length("text") == 0) | (F.col("h3") % 100 >= 100 - plain_percent)
    for mark in marks:
        whole |= F.contains("text", F.lit(mark))
    rows = rows.select("doc_id", "text", *drawn).select(
        "doc_id", "text", "h1", "h2", F.when(whole, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm").alias("form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = marks
        for batch in batches:
            counts, heads, bodies, outputs = [], [], [], []
            for text, h1, h2, form in zip(*(batch.column(c).to_pylist() for c in ("text", "h1", "h2", "form"))):
                index = RankIndex(text)
                counts.append(index.count)
                if form == "plain":
                    heads.append(None)
                    bodies.append(None)
                    outputs.append(text)
                    continue
                low, high = sorted((h1 % (index.count + 1), h2 % (index.count + 1)))
                first, after = index.offset(low), index.offset(high)
                parts = (p, text[:first], s, text[after:], m, text[first:after])
                heads.append(low)
                bodies.append(high - low)
                outputs.append(b"".join(parts if form == "psm" else (*parts[2:4], *parts[:2], *parts[4:])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), batch.column("form"), pa.array(heads, pa.int64()), pa.array(bodies, pa.int64()), pa.array(outputs, pa.binary())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    made = map_batches(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)):
    """The original text from ``output`` and ``form``; a text that holds a sentinel is plain, so each stands once."""
    parts = F.split("output", "|".join(rf"\Q{s}\E" for s in sentinels))
    one, two, three = (F.element_at(parts, n) for n in (2, 3, 4))
    return F.when(F.col("form") == "psm", F.concat(one, three, two)).when(F.col("form") == "spm", F.concat(two, three, one)).otherwise(F.col("output"))


def infill_digest(made: DataFrame) -> DataFrame:
    """The lengths, and digests of the output and of the text rebuilt from it."""
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored().cast("binary"), 256).alias("restored_sha256"))
