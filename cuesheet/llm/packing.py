"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Each document is tokenized, closed with an end id, and cut only where it is longer than a sequence.
Pieces are dealt evenly into groups of about ``group_pieces`` (so the number of groups grows with the
input), and each group is packed by several islands. An individual is a list of bins. Crossover
injects the other parent's well-filled bins whole, removes bins that would hold a piece twice, and
puts the displaced pieces back by best fit decreasing. Between two rounds each island receives its
neighbour's elite; the best elite of a group is its packing. Evolution stops early where the
number of bins equals the lower bound.

Defined results: a null text is an empty document, one piece with the end id only. Repeated rows are
packed one by one. Very long texts are tokenized whole and cut into full sequences. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import os
import random
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cuesheet.llm.common import map_batches
from cuesheet.plans.session import stage

CAPACITY, END_ID, GROUP_PIECES, ISLANDS = 4096, 1, 2048, 2
POPULATION, GENERATIONS, OFFSPRING = 5, 6, 4
CACHED_WORDS = 800_000
#: Split at by str.split() but not white space for the tokenizer.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


class _WordIds(dict):
    """Chunk of text without white space -> its ids as bytes, computed at the first use.

    A chunk of Latin letters is one word for the vocabulary's model, and a full stop or comma after it is
    another; everything else goes through the whole tokenizer."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies keep as they are
        other = [b for b in range(256) if b not in kept]
        self.alphabet = {b: 256 + n for n, b in enumerate(other)}

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha() and plain(chunk):
            tokens = self.model.tokenize(chunk.lower().encode().decode("latin-1").translate(self.alphabet))
            ids = np.array([t.id for t in tokens], dtype="<u4").tobytes()
        elif len(chunk) > 1 and chunk[-1] in ".," and chunk[:-1].isalpha() and plain(chunk):
            ids = self[chunk[:-1]] + self[chunk[-1]]
        else:
            ids = whole(self.tokenizer, chunk)
        self[chunk] = ids
        return ids


def plain(text: str) -> bool:
    """Latin and already composed, so that lower case goes character by character."""
    return text.isascii() or (max(text) < "\u0250" and "\u0130" not in text and unicodedata.is_normalized("NFC", text))


def whole(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class WordTokenizer:
    """Token ids as little-endian 32-bit bytes. The vocabulary never joins characters across white space,
    so ids of white-space separated chunks are computed once and kept, within a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known = _WordIds(Tokenizer.from_file(path))

    def encode(self, text: str) -> bytes:
        if any(c in text for c in _SEPARATORS):
            return whole(self.known.tokenizer, text)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        # special tokens are upper and lower case sensitive; all other text is lower-cased by the tokenizer anyway
        words = (text.lower() if text and "<" not in text and plain(text) else text).split()
        return b"".join(map(self.known.__getitem__, words))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each document."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _TOKENIZERS.setdefault(tokenizer_path, None) or WordTokenizer(tokenizer_path)
        _TOKENIZERS[tokenizer_path] = tokenizer
        for batch in batches:
            rows = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = tokenizer.encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for column, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of piece numbers for given lengths."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity, self.bins, self.fills = lengths, capacity, [], []

    def copy_of(self, bins: list[list[int]]) -> Packing:
        new = Packing(self.lengths, self.capacity)
        new.bins = [list(b) for b in bins]
        new.fills = [sum(self.lengths[i] for i in b) for b in bins]
        return new

    def best_fit(self, items: list[int]) -> Packing:
        """Put each item, in the given order, where the least room is left."""
        rooms = sorted((self.capacity - f, n) for n, f in enumerate(self.fills))
        for item in items:
            size = self.lengths[item]
            at = bisect_left(rooms, (size, -1))
            if at < len(rooms):
                room, number = rooms.pop(at)
                self.bins[number].append(item)
            else:
                room, number = self.capacity, len(self.bins)
                self.bins.append([item])
                self.fills.append(0)
            self.fills[number] += size
            insort(rooms, (room - size, number))
        return self

    def decreasing(self, items: list[int]) -> list[int]:
        return sorted(items, key=lambda i: (-self.lengths[i], i))

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        return -len(self.bins), sum((f / self.capacity) ** 2 for f in self.fills)

    def cross(self, other: Packing, dice: random.Random) -> Packing:
        """Inject a share of the other's fullest bins, and repack what they displace."""
        order = sorted(range(len(other.bins)), key=lambda n: (-other.fills[n], n))
        chosen = order[: max(1, int(len(order) * dice.uniform(0.2, 0.6)))]
        taken = {i for n in chosen for i in other.bins[n]}
        kept = [b for b in self.bins if taken.isdisjoint(b)]
        child = self.copy_of([other.bins[n] for n in chosen] + kept)
        placed = {i for b in child.bins for i in b}
        return child.best_fit(self.decreasing([i for i in range(len(self.lengths)) if i not in placed]))

    def mutate(self, dice: random.Random) -> Packing:
        """Empty the worst bins and some others, and put their pieces back."""
        order = sorted(range(len(self.bins)), key=lambda n: (self.fills[n], n))
        gone = set(order[: max(2, len(order) // 50)]) | set(dice.sample(order, min(len(order), 3)))
        child = self.copy_of([b for n, b in enumerate(self.bins) if n not in gone])
        return child.best_fit(self.decreasing([i for n in gone for i in self.bins[n]]))


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[list[list[int]]]) -> Packing:
    """The best packing of one island after some generations; ``elites`` join its population."""
    empty, dice = Packing(lengths, capacity), random.Random(seed)
    bound = -(-sum(lengths) // capacity)
    people = [empty.copy_of(bins) for bins in elites]
    order = empty.decreasing(list(range(len(lengths))))
    while len(people) < POPULATION and not (people and len(people[-1].bins) == bound):
        people.append(empty.copy_of([]).best_fit(order))
        order = sorted(order, key=lambda i: -lengths[i] * dice.uniform(0.8, 1.2))
    people.sort(key=Packing.fitness, reverse=True)
    for _ in range(GENERATIONS):
        if len(people[0].bins) <= bound:
            break
        for _ in range(OFFSPRING):
            first, second = dice.sample(people, 2)
            people.append(first.cross(second, dice).mutate(dice))
        people = sorted(people, key=Packing.fitness, reverse=True)[:POPULATION]
    return people[0]


def _numbers(bins: list[list[int]], count: int) -> list[int]:
    at = [0] * count
    for number, items in enumerate(bins):
        for item in items:
            at[item] = number
    return at


def _bins(numbers: list[int] | None) -> list[list[list[int]]]:
    if numbers is None:
        return []
    bins = [[] for _ in range(max(numbers, default=-1) + 1)]
    for item, number in enumerate(numbers):
        bins[number].append(item)
    return [bins]


def _round(groups: DataFrame, capacity: int, turn: int) -> DataFrame:
    """Evolve each (group, island, items, own, migrant) and return it with its elite in ``own``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts, fills = [], [], []
            for row in batch.select(["group", "island", "lengths", "own", "migrant"]).to_pylist():
                seed = row["group"] * 1000 + row["island"] * 10 + turn
                best = evolve(row["lengths"], capacity, seed, _bins(row["own"]) + _bins(row["migrant"]))
                found.append(_numbers(best.bins, len(row["lengths"])))
                counts.append(-best.fitness()[0])
                fills.append(best.fitness()[1])
            kept = [batch.column(n) for n in ("group", "island", "items", "lengths")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.int64()), pa.array(fills, pa.float64())],
                names=["group", "island", "items", "lengths", "own", "bins", "fill"])

    item = "struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long>"
    return map_batches(
        groups.select("group", "island", "items", "lengths", "own", "migrant"), run,
        f"group long, island int, items array<{item}>, lengths array<long>, own array<int>, bins long, fill double")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, islands: int = ISLANDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset). ``pieces`` must be a stored table."""
    groups = max(1, -(-pieces.count() // group_pieces))
    fields = ("doc_id", "piece", "start", "length", "ids_crc32")
    # row numbers of a stored table are the same whenever a task runs again
    dealt = pieces.select(F.struct(*fields).alias("item"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("group"))
    nothing = F.lit(None).cast("array<int>")
    settled = dealt.groupBy("group").agg(F.array_sort(F.collect_list("item")).alias("items")).select(
        "group", "items", F.col("items.length").alias("lengths"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        nothing.alias("own"), nothing.alias("migrant"))
    first = stage(_round(settled, capacity, 1), "islands")
    sent = first.select("group", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("own").alias("migrant"))
    second = _round(first.join(sent, ["group", "island"]), capacity, 2)
    best = second.groupBy("group").agg(
        F.max_by(F.struct("items", "own"), F.struct(-F.col("bins"), F.col("fill"), -F.col("island"))).alias("elite"))
    placed = best.select("group", F.explode(F.arrays_zip(F.col("elite.items").alias("item"), F.col("elite.own").alias("bin"))).alias("p"))
    sequence = F.col("group") * (1 << 20) + F.col("p.bin")
    rows = placed.select(*[F.col(f"p.item.{f}").alias(f) for f in fields], sequence.alias("sequence_id"))
    # a sequence has at most ``capacity`` pieces, since each holds at least one id
    earlier = W.partitionBy("sequence_id").orderBy(*fields).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(stage(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
