"""Exact repeated byte strings by deep-shallow suffix sorting.

Sorting every suffix of a corpus is not needed to find strings of ``LENGTH`` bytes that start twice.
Among the GRAM-byte substrings of such a string, the one with the smallest hash (the last of equals) is its
anchor; equal strings have equal anchors at equal offsets. So texts are reduced to anchors, each
owning a run of string starts, and only suffixes at anchors are sorted, next to those that
share the anchor's bytes: forwards from the anchor, and backwards before it. Sorting is multikey
quicksort to a shallow depth; groups that agree that far are ordered by blind tries, which look
at branching bytes only and compare one string per insertion. Neighbours' common prefixes of both orders
give, for each anchor, every maximal match of LENGTH or more bytes.

Steps: (1) anchors of all rows as hashes; (2) anchors with one place in the corpus go; (3) the
bytes around the others, once per distinct text and once per distinct surrounding, are dealt by anchor and
sorted; (4) matches are merged per text and cut out. Copies of a text are one text with a count: a copy
of LENGTH bytes or more loses all. Anchors with more than GROUP_LIMIT surroundings are not gathered: each
of their strings is hashed and counted instead, merged before the shuffle, which is exact as well.

Defined results: a null text is empty. Texts shorter than LENGTH lose nothing. Cuts are at bytes
and may fall inside a character. Very long texts are read whole, in segments of ``SEGMENT`` starts; an empty table gives no rows. Rows are judged by text alone, so nulls and repeats of doc_id do not
matter. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuesheet.llm.common import map_batches, merged_spans
from cuesheet.plans.session import stage

LENGTH, GRAM = 400, 64
SHALLOW, SYMBOL = 32, 8
GROUP_LIMIT = 4096
#: Starts hashed at once, so that a very long text needs no more memory than this many.
SEGMENT = 1 << 20
#: Span lists of so many texts are sent to all tasks; more are joined by a shuffle.
BROADCAST_TEXTS, BROADCAST_SPANS = 200_000, 1_000_000

_U64 = np.uint64
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION_BITS = 22
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < count:
        for at, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(1 << (count - 1).bit_length(), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[at] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:count], _POWERS[1][:count]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    return x ^ (x >> _U64(32))


class Hashed:
    """Hashes of any substrings of one byte string, from prefix sums."""

    def __init__(self, data: bytes):
        values = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + _U64(1)
        power, self.inverse = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * power[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window, from running minima of blocks in both directions."""
    count = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:len(values)] = values
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1:width - 1 + count])


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, context hash, first start, starts, anchor position) per anchor, for segments of a text."""
    for base in range(0, len(data) - LENGTH + 1, SEGMENT):
        part = data[base:base + SEGMENT + LENGTH - 1]
        hashed = Hashed(part)
        at = np.arange(len(part) - GRAM + 1)
        grams = hashed.of(at, at + GRAM)
        packed = (grams >> _U64(_POSITION_BITS) << _U64(_POSITION_BITS)) | ((1 << _POSITION_BITS) - 1 - at).astype(np.uint64)
        least = _sliding_least(packed, LENGTH - GRAM + 1)
        chosen = ((1 << _POSITION_BITS) - 1) - (least & _U64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        count = np.diff(first, append=len(chosen))
        place = chosen[first]
        yield grams[place].view(np.int64), hashed.of(first, first + count - 1 + LENGTH).view(np.int64), base + first, count, base + place


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """Patricia trie over (a group of) strings: inner nodes keep a depth and one child per branching byte."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root: list = [None, [first]]  # leaf: [None, members]; inner: [depth, {byte: node}]

    def _byte(self, item: int, depth: int) -> int:
        text = self.strings[item]
        return text[depth] if depth < len(text) else -1

    def add(self, item: int) -> None:
        node = self.root
        while node[0] is not None:  # blind descent: any leaf will do where a branch is missing
            node = node[1].get(self._byte(item, node[0])) or next(iter(node[1].values()))
        member = node[1][0]
        depth = common_prefix(self.strings[item], self.strings[member])
        if depth == len(self.strings[item]) == len(self.strings[member]):
            node[1].append(item)
            return
        node = self.root
        while node[0] is not None and node[0] < depth:
            node = node[1][self._byte(item, node[0])]
        if node[0] == depth:
            node[1][self._byte(item, depth)] = [None, [item]]
        else:
            node[:] = [depth, {self._byte(member, depth): list(node), self._byte(item, depth): [None, [item]]}]

    def walk(self) -> Iterator[tuple[int, int | None]]:
        """(item, common prefix with the item before) in order; None for the first."""
        stack, shared = [(self.root, None)], None
        while stack:
            node, shared = stack.pop()
            if node[0] is None:
                for item in node[1]:
                    yield item, shared
                    shared = len(self.strings[item])
            else:
                children = [node[1][b] for b in sorted(node[1])]
                stack += [(child, node[0]) for child in children[:0:-1]] + [(children[0], shared)]


def deep_shallow(strings: list[bytes], start: int = 0) -> tuple[list[int], list[int]]:
    """Order of the strings, and common prefixes of neighbours; all agree in their first ``start`` bytes."""
    order: list[int] = []
    shared: list[int] = []

    def put(item: int, prefix: int | None, entry: int | None) -> None:
        if order:
            shared.append(entry if prefix is None else prefix)
        order.append(item)

    # multikey quicksort on symbols of SYMBOL bytes; an entry is the prefix shared with what comes before
    stack: list[tuple[list[int], int, int | None]] = [(list(range(len(strings))), start, None)]
    while stack:
        group, depth, entry = stack.pop()
        if len(group) == 1:
            put(group[0], None, entry)
        elif depth - start >= SHALLOW:
            trie = BlindTrie(strings, group[0])
            for item in group[1:]:
                trie.add(item)
            for item, prefix in trie.walk():
                put(item, prefix, entry)
        else:
            symbols = [strings[i][depth:depth + SYMBOL] for i in group]
            pivot = sorted(symbols)[len(symbols) // 2]
            parts: tuple[list[int], list[int], list[int]] = ([], [], [])
            for item, symbol in zip(group, symbols):
                parts[(symbol > pivot) - (symbol < pivot) + 1].append(item)
            less, same, more = parts
            ended = len(pivot) < SYMBOL

            def edge(left: list[int], right: list[int]) -> int:
                """Prefix shared across two parts: the largest of the left meets the smallest of the right."""
                low = max(left, key=lambda i: strings[i][depth:depth + SYMBOL])
                high = min(right, key=lambda i: strings[i][depth:depth + SYMBOL])
                return depth + common_prefix(strings[low][depth:depth + SYMBOL], strings[high][depth:depth + SYMBOL])

            todo = []
            if less:
                todo.append((less, depth, entry))
            if ended:  # equal to their ends
                todo += [([item], depth, (edge(less, same) if less else entry) if n == 0 else len(strings[item])) for n, item in enumerate(same)]
            else:
                todo.append((same, depth + SYMBOL, edge(less, same) if less else entry))
            if more:
                todo.append((more, depth, edge(same, more)))
            stack += todo[::-1]
    return order, shared


def matches(contexts: list[bytes], places: list[int]) -> list[list[tuple[int, int]]]:
    """Spans of each context that match another one around the anchor in LENGTH bytes or more."""
    count = len(contexts)
    right = [c[p:] for c, p in zip(contexts, places)]
    left = [c[:p][::-1] for c, p in zip(contexts, places)]
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    by_right, right_shared = deep_shallow(right, GRAM)
    rank = [0] * count
    for n, item in enumerate(by_right):
        rank[item] = n
    by_left, left_shared = deep_shallow(left)
    # join neighbours of the backward order from the longest shared part down
    group_of = list(range(count))
    members = [[rank[item]] for item in by_left]
    levels: dict[int, list[int]] = {}
    for n, prefix in enumerate(left_shared):
        levels.setdefault(prefix, []).append(n)
    for prefix in sorted(levels, reverse=True):
        changed = set()
        for n in levels[prefix]:
            a, b = _root(group_of, n), _root(group_of, n + 1)
            if len(members[a]) < len(members[b]):
                a, b = b, a
            group_of[b] = a
            members[a] += members[b]
            members[b] = []
            changed.discard(b)
            changed.add(a)
        for a in changed:
            ranks = sorted(members[a])
            steps = [min(right_shared[x:y]) for x, y in zip(ranks, ranks[1:])]
            for n, x in enumerate(ranks):
                best = max(steps[n - 1] if n else 0, steps[n] if n < len(steps) else 0)
                if prefix + best >= LENGTH:
                    item = by_right[x]
                    found[item].append((places[item] - prefix, places[item] + best))
    return found


def _root(parent: list[int], n: int) -> int:
    while parent[n] != n:
        parent[n] = parent[parent[n]]
        n = parent[n]
    return n


def _identified(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest): digest, 16 bytes, stands for the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16).alias("digest"))


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """(digest, key, context, first, starts, place) of every anchor; context hashes the owned bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, owners = [], []
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
                for part in anchors(text.encode("utf-8", "surrogatepass")):
                    parts.append(part)
                    owners += [digest] * len(part[0])
            if parts:
                columns = [np.concatenate([p[n] for p in parts]).astype(np.int64) for n in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owners, pa.binary()), *map(pa.array, columns)], names=["digest", "key", "context", "first", "starts", "place"])

    rows = texts.filter(F.octet_length("text") >= LENGTH).select("digest", "text")
    return map_batches(rows, run, "digest binary, key long, context long, first long, starts long, place long")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, context, place, bytes) of the wanted (digest, items); each distinct text is read once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], [], []]
            for text, items in zip(batch.column("text").to_pylist(), batch.column("items").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                for item in items:
                    first = item["first"]
                    part = data[first:first + item["starts"] - 1 + LENGTH]
                    for column, value in zip(rows, (item["key"], item["context"], item["place"] - first, part)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["key", "context", "place", "bytes"])

    # copies merge before the shuffle
    texts = _identified(docs).filter(F.octet_length("text") >= LENGTH).groupBy("digest").agg(F.first("text").alias("text"))
    return map_batches(texts.join(wanted, "digest").select("text", "items"), run, "key long, context long, place long, bytes binary")


def _sorted_matches(contexts: DataFrame) -> DataFrame:
    """(key, context, spans) where a context matches another one of its key."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def settled(group: list[tuple], out: list[tuple]) -> None:
            if len(group) > 1:
                for row, spans in zip(group, matches([r[3] for r in group], [r[2] for r in group])):
                    if spans:
                        out.append((row[0], row[1], [{"first": a, "after": b} for a, b in set(spans)]))

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], kind)],
                names=["key", "context", "spans"])

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(n).to_pylist() for n in ("key", "context", "place", "bytes"))):
                if rows and rows[0][0] != row[0]:
                    settled(rows, out)
                    rows = []
                rows.append(row)
            yield table(out)
        out = []
        settled(rows, out)
        yield table(out)

    dealt = contexts.repartition("key").sortWithinPartitions("key")
    return map_batches(dealt, run, "key long, context long, spans array<struct<first: long, after: long>>")


def _counted_matches(contexts: DataFrame) -> DataFrame:
    """The same for keys with very many contexts: every owned string is hashed and counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, context, data in zip(*(batch.column(n).to_pylist() for n in ("key", "context", "bytes"))):
                at = np.arange(len(data) - LENGTH + 1)
                rows.append((np.full(len(at), key), np.full(len(at), context), at, Hashed(data).of(at, at + LENGTH).view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([r[n] for r in rows])) for n in range(4)], names=["key", "context", "at", "string"])

    strings = map_batches(contexts, run, "key long, context long, at long, string long")
    twice = strings.groupBy("key", "string").agg(F.count("*").alias("n")).filter("n > 1").select("key", "string")
    return strings.join(twice, ["key", "string"]).groupBy("key", "context").agg(
        F.collect_list(F.struct(F.col("at").alias("first"), (F.col("at") + LENGTH).alias("after"))).alias("spans"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(digest, spans): merged byte spans to remove from each distinct text that shares strings with another
    place. Copies as a whole are not listed here."""
    rows = stage(_anchor_rows(_identified(docs)), "anchors")
    tag = F.xxhash64("digest", "first")
    # stored, so that joins with them can split an anchor that very many texts share
    keys = stage(rows.groupBy("key").agg(F.min(tag).alias("low"), F.max(tag).alias("high")).filter("low <> high").select("key"), "keys")
    rows = stage(rows.join(keys, "key", "left_semi"), "shared")
    # surroundings of each shared anchor, with one place that stands for all equal ones
    around = stage(rows.groupBy("key", "context").agg(
        F.min(tag).alias("low"), F.max(tag).alias("high"), F.min(F.struct("digest", "first", "starts", "place")).alias("one")), "around")
    sizes = stage(around.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    chosen = around.join(sizes, "key").select("key", "context", "one", "n")
    wanted = chosen.groupBy("one.digest").agg(F.collect_list(F.struct(
        "key", "context", "one.first", "one.starts", "one.place")).alias("items"))
    contexts = stage(_contexts(docs, wanted), "contexts").join(sizes.withColumnRenamed("n", "size"), "key")
    found = stage(_sorted_matches(contexts.filter(F.col("size") <= GROUP_LIMIT).select("key", "context", "place", "bytes")).unionByName(
        _counted_matches(contexts.filter(F.col("size") > GROUP_LIMIT).select("key", "context", "bytes"))), "matches")
    twins = around.filter("low <> high").select("key", "context")
    whole = rows.join(twins, ["key", "context"]).select(
        "digest", F.array(F.struct(F.col("first"), (F.col("first") + F.col("starts") - 1 + LENGTH).alias("after"))).alias("spans"))
    parts = rows.join(found, ["key", "context"]).select("digest", F.expr(
        "transform(spans, s -> named_struct('first', first + s.first, 'after', first + s.after))").alias("spans"))
    return whole.unionByName(parts).distinct().groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans")).select(
        "digest", merged_spans("spans", "bigint").alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row: what goes, and the bytes that stay."""
    named = _identified(docs)
    copies = named.select("digest", F.octet_length("text").alias("n")).filter(F.col("n") >= LENGTH).groupBy("digest").agg(
        F.count("*").alias("copies"), F.first("n").cast("long").alias("n")).filter("copies > 1")
    everything = copies.select("digest", F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n").alias("after"))).alias("all"))
    spans = stage(repeated_spans(docs).join(everything, "digest", "full_outer").select(
        "digest", F.coalesce("all", "spans").alias("spans")), "spans")
    size = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    sent = F.broadcast(spans) if size[0] <= BROADCAST_TEXTS and size[1] <= BROADCAST_SPANS else spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data, at, parts = text.encode("utf-8", "surrogatepass"), 0, []
                for span in spans or ():
                    parts.append(data[at:span["first"]])
                    at = span["after"]
                kept.append(b"".join([*parts, data[at:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), batch.column("spans"), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])

    joined = named.join(sent, "digest", "left").select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), "spans")
    return map_batches(joined, run, "doc_id long, n_bytes long, spans array<struct<first: long, after: long>>, kept binary")


def removal_digest(removed: DataFrame) -> DataFrame:
    return removed.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
