"""Near-duplicate detection with b-bit MinHash.

A text's set holds the hashes of its 5-word shingles: words are hashed by BLAKE2 to 64 bits, which, unlike
polynomials modulo 2^64, has no known pairs of colliding words. Each distinct set keeps ``BITS`` low bits of
each of BANDS * ROWS minima, packed into longs, and one key per band of minima. Sets that share a band key
are candidates; bit counts of the packed signatures, corrected for chance collisions, estimate
their similarity. A parity bit per hash slot bounds the similarity from above without error. Candidates
that pass both, near or above the threshold, are confirmed on the full sets.

Equal sets are one node from the start. In each band bucket every node is first compared with the
bucket's smallest node only. After components of those links are known, nodes of one bucket that
are still apart are compared as well, without the pairs inside the bucket's largest component: so no
link that a bucket shows is lost, and large groups of copies never become all pairs. With 51 bands of 5
rows a pair at similarity 0.75 shares no bucket with probability 1e-6; the estimate lets pass what
is within 4.5 standard deviations of the threshold.

Very long texts are hashed whole, and an empty table gives an empty one. Defined results: A-Z is lower-cased; words are runs of characters other than space and U+0009-000D;
with fewer than five words the whole sequence is the only shingle; a null or wordless text has an
empty set, is linked with nothing and kept. A row with a null doc_id is compared like any other but names no
component; without a row with an id its component is null. Repeated rows share their component. Other
columns are ignored. ``near_duplicates`` judges ids: ``kept`` says whether a row has its component's id. ``keep_one``
judges rows by a stored key: exactly one row of each component stays, the one with the smallest doc_id (nulls
last), then digest, then key, so null and repeated ids do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.llm.common import map_batches
from cuesheet.llm.components import components
from cuesheet.plans.session import stage

SHINGLE, BANDS, ROWS, BITS, PARITY = 5, 51, 5, 4, 2048
HASHES = BANDS * ROWS
PERCENT = 75
DEVIATIONS = 4.5
#: So many ids of texts that have candidates are sent to all tasks; more are joined by a shuffle.
BROADCAST_IDS = 500_000

_U64 = np.uint64
_DICE = np.random.default_rng(20240229)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _DICE.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * _U64(2) + _U64(1)
_MULTIPLY = (_DICE.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))
_ADD = _DICE.integers(0, 1 << 32, HASHES, dtype=np.uint32)
def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


class _WordHashes(dict):
    """64-bit BLAKE2 hashes of words, each made once while it stays in the table."""

    ROOM = 50_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.ROOM:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_HASHES = _WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text. ``bytes.split`` cuts at U+0020 and U+0009-000D."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    words = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    width = min(SHINGLE, len(words))
    shingles = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for place in range(width):
        shingles += words[place:len(words) - width + 1 + place] * _PLACE[place]
    return np.unique(_mix(shingles))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set that is not empty."""
    small, low = (shingles >> _U64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for first in range(0, len(small), 1024):
        part = small[first:first + 1024]
        low = np.minimum(low, (part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _U64(_BASE)
    for row in range(ROWS):
        keys = _mix(keys ^ low.reshape(BANDS, ROWS)[:, row].astype(np.uint64)) * _U64(_INVERSE)
    return keys.view(np.int64)


def packed_bits(low: np.ndarray) -> np.ndarray:
    """BITS bits of each minimum, lane by lane, in longs."""
    lanes = 64 // BITS
    bits = ((low * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.uint64)
    padded = np.zeros(-(-HASHES // lanes) * lanes, dtype=np.uint64)
    padded[:HASHES] = bits
    shifts = np.arange(lanes, dtype=np.uint64) * _U64(BITS)
    return np.bitwise_or.reduce(padded.reshape(-1, lanes) << shifts, axis=1).view(np.int64)


def least_matches(percent: int = PERCENT, deviations: float = DEVIATIONS) -> int:
    """Equal lanes that a pair at the threshold has, chance collisions included, less the allowed deviation."""
    chance = 2.0 ** -BITS
    share = chance + (1 - chance) * percent / 100
    return int(HASHES * share - deviations * (HASHES * share * (1 - share)) ** 0.5)


def equal_lanes(a: str, b: str) -> Column:
    """Lanes in which two packed signatures agree, by bit counts."""
    words = -(-HASHES // (64 // BITS))
    terms = []
    for word in range(words):
        x = f"({a}[{word}] ^ {b}[{word}])"
        folded = f"({x} | shiftrightunsigned({x}, 1))"
        folded = f"({folded} | shiftrightunsigned({folded}, 2))"
        terms.append(f"bit_count({folded} & {0x1111111111111111}L)")
    return F.expr(f"{HASHES} - ({' + '.join(terms)})")


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """For each of PARITY hash slots, whether it holds an odd number of the set's shingles, in longs."""
    odd = np.bincount((shingles & _U64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def not_too_different(percent: int) -> Column:
    """Slots of unequal parity are a lower bound of the symmetric difference, and so an upper bound of the
    similarity; pairs above the threshold always pass. Every filter here is on both sides' columns a_*, b_*."""
    unequal = " + ".join(f"bit_count(a_parity[{n}] ^ b_parity[{n}])" for n in range(PARITY // 64))
    return F.expr(f"({unequal}) * {100 + percent} <= (a_n + b_n) * {100 - percent}")


def sketches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_shingles, digest, bands, bits, parity) of every row; digest stands for the set."""
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands, bits, parity = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text)
                low = minima(shingles) if len(shingles) else None
                sizes.append(len(shingles))
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                bands.append(None if low is None else band_keys(low))
                bits.append(None if low is None else packed_bits(low))
                parity.append(None if low is None else parity_bits(shingles))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, kind), pa.array(bits, kind), pa.array(parity, kind)],
                names=["row", "doc_id", "n_shingles", "digest", "bands", "bits", "parity"])

    rows = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, run, "row long, doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>, parity array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted (node, row); shingles are sorted 64-bit hashes as bytes."""
    ids = wanted.select("row", "node")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    rows = docs.select("row", "text").join(ids, "row").select("node", "text")
    return map_batches(rows, run, "node long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return map_batches(pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y"), run, "a long, b long")


def _labelled(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of a stored table (row, doc_id, text), and (digest, place, label) of each distinct set that is not
    empty; place is the first (unnamed, doc_id, digest, row) of the set's rows."""
    all_rows = stage(sketches(docs), "sketches")
    # equal sets become one node; numbers are given while the table is written
    nodes = stage(
        all_rows.filter("n_shingles > 0").groupBy("digest")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "row")).alias("place"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("parity").alias("parity"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    # stored, so that joins with them can split a bucket that very many nodes share
    shared = stage(banded.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("leader")).filter("size > 1"), "shared")
    members = stage(banded.join(shared.select("key", "leader"), "key"), "buckets")
    traits = nodes.select("node", "n", "bits", "parity")

    def ends(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(traits.select(*[F.col(c).alias(f"{side}_{c}".replace(f"{side}_node", side)) for c in traits.columns]), side)
        return pairs

    alike = F.expr(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)") & (
        equal_lanes("a_bits", "b_bits") >= least_matches(percent)) & not_too_different(percent)
    stars = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    stars = stage(ends(stars).filter(alike).select("a", "b"), "pairs")
    wanted = nodes.join(stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct(), "node", "left_semi")
    links = stage(_confirmed(stars, stage(_full_sets(docs, wanted.select("node", "place.row")), "sets"), percent), "links")
    labels = components(links)

    # nodes of one bucket that the stars left in different components
    placed = members.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = placed.groupBy("key", "label").agg(F.count("*").alias("size"))
    mixed = stage(parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("label", "size").alias("largest")).filter("parts > 1").select("key", "largest"), "mixed")
    apart = stage(placed.join(mixed, "key").join(traits, "node"), "apart")
    left = apart.select("key", F.col("node").alias("a"), F.col("label").alias("a_label"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits"), F.col("parity").alias("a_parity"), (F.col("label") == F.col("largest")).alias("a_largest"))
    right = apart.filter("label <> largest").select(F.col("key").alias("b_key"), F.col("node").alias("b"), F.col("label").alias("b_label"), F.col("n").alias("b_n"), F.col("bits").alias("b_bits"), F.col("parity").alias("b_parity"))
    across = left.join(right, (F.col("key") == F.col("b_key")) & (F.col("a_label") != F.col("b_label")) & (F.col("a_largest") | (F.col("a") < F.col("b"))) & alike)
    rest = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = stage(rest.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
    wanted = nodes.join(rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct(), "node", "left_semi")
    more = _confirmed(rest, stage(_full_sets(docs, wanted.select("node", "place.row")), "sets"), percent)
    links = stage(links.union(more), "links")

    labels = components(links)
    classes = nodes.select("node", "digest", "place").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return all_rows, stage(classes.select("digest", "place", "label"), "classes")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row."""
    all_rows, classes = _labelled(stage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows"), percent)
    lowest = classes.groupBy("label").agg(F.min("place.doc_id").alias("component"))
    named = classes.join(lowest, "label").select("digest", "component")
    return all_rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component and all rows with empty sets, all columns as they came."""
    key = "row"
    while key.lower() in (c.lower() for c in docs.columns):
        key += "_"
    rows = stage(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    all_rows, classes = _labelled(rows.select(F.col(key).alias("row"), "doc_id", "text"), percent)
    first = classes.groupBy("label").agg(F.min("place").alias("first"))
    stays = classes.join(first, "label").select("digest", F.col("first.row").alias("first"))
    gone = all_rows.filter("n_shingles > 0").select("row", "digest").join(stays, "digest").filter("row <> first")
    gone = stage(gone.select(F.col("row").alias(key)), "dropped")
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key, "left_anti").drop(key)
