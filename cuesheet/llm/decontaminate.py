"""Benchmark decontamination by Wu-Manber search for word windows.

Texts are sequences of words: runs of ASCII digits and letters (A-Z lower-cased) and of characters
beyond ASCII. The patterns are all windows of ``window`` consecutive words of each benchmark item; an
item with fewer words is one pattern. For each pattern length, a shift table over blocks of two words
tells how far the search may jump; where a block ends a pattern, the bucket of that suffix lists
the patterns, a hash of the first words chooses among them, and direct comparison confirms.

Patterns are sent to the tasks in blocks of bounded size, each block in a pass of its own over
all rows, so a benchmark of any size works. The documents are never shuffled.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no
pattern; an item with a null item_id marks words but is not listed. Items with equal texts are all
listed. Very long texts are searched whole; an empty table gives no rows, an empty benchmark no hits. Repeated rows are judged one by one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuesheet.llm.common import map_batches, merged_spans

WINDOW = 10
#: Text bytes of the benchmark items whose patterns one pass over the documents looks for.
BLOCK_BYTES = 8_000_000
_WORD = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8; ``bytes.lower`` changes A-Z only."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_WORD).split() if text else []


class WuManber:
    """Search tables for patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.skip = self.length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[tuple[tuple[bytes, ...], list[int]]]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, self.length + 1):
                key = b" ".join(pattern[end - self.block:end])
                self.shift[key] = min(self.shift.get(key, self.skip), self.length - end)
            self.buckets.setdefault(key, {}).setdefault(pattern[0], []).append((pattern, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of each occurrence."""
        shift, skip, length, two = self.shift, self.skip, self.length, self.block == 2
        at, count = length - 1, len(words)
        while at < count:
            key = words[at - 1] + b" " + words[at] if two else words[at]
            jump = shift.get(key, skip)
            if jump:
                at += jump
                continue
            start = at - length + 1
            for pattern, items in self.buckets[key].get(words[start], ()):
                if tuple(words[start:at + 1]) == pattern:
                    yield start, items
            at += 1


def search_tables(items: list[tuple[int | None, str | None]], window: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for item_id, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for start in range(len(words) - length + 1 if length else 0):
            pattern = tuple(words[start:start + length])
            by_length.setdefault(length, {}).setdefault(pattern, []).append(item_id)
    return [WuManber(patterns) for _, patterns in sorted(by_length.items())]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


_STATE = "doc_id long, text string, n_words long, hits array<struct<first: int, after: int>>, items array<long>"


def _search_pass(df: DataFrame, block: list[tuple[int | None, str | None]], window: int) -> DataFrame:
    """Add the hits of one block of items to (doc_id, text, n_words, hits, items)."""
    sent = df.sparkSession.sparkContext.broadcast(block)
    fields = pa.schema([
        ("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()),
        ("hits", pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))), ("items", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = search_tables(sent.value, window)
        for batch in batches:
            rows = batch.to_pydict()
            counts = []
            for at, text in enumerate(rows["text"]):
                words = words_of(text)
                counts.append(len(words))
                spans, found = rows["hits"][at], set(rows["items"][at])
                for table in tables:
                    for start, items in table.search(words):
                        found.update(items)
                        if spans and spans[-1]["first"] <= start <= spans[-1]["after"]:
                            spans[-1]["after"] = max(spans[-1]["after"], start + table.length)
                        else:
                            spans.append({"first": start, "after": start + table.length})
                rows["items"][at] = list(found)
            rows["n_words"] = counts
            yield pa.RecordBatch.from_pydict(rows, schema=fields)

    return map_batches(df, run, _STATE)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): hit words, item_ids found, and the hit word spans."""
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<first: int, after: int>>)").alias("hits"),
        F.expr("cast(array() as array<bigint>)").alias("items"),
    )
    passes = 0
    for block in _blocks(benchmark, block_bytes):
        found = _search_pass(found, block, window)
        passes += 1
    if not passes:
        found = _search_pass(found, [], window)
    return found.select("doc_id", "n_words", merged_spans("hits", "int").alias("spans"), F.array_distinct("items").alias("items")).select(
        "doc_id", "n_words", "spans", "items",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.after - s.first)").alias("n_hit"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows without any hit, all columns as they came; one pass over the rows for each block of items."""

    def clean(df: DataFrame, block: list[tuple[int | None, str | None]]) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = search_tables(sent.value, window)
            for batch in batches:
                keep = []
                for text in batch.column("text").to_pylist():
                    words = words_of(text)
                    keep.append(not any(next(table.search(words), None) for table in tables))
                yield batch.filter(pa.array(keep, pa.bool_()))

        return map_batches(df, run, df.schema)

    for block in _blocks(benchmark, block_bytes):
        docs = clean(docs, block)
    return docs


def contamination_digest(found: DataFrame) -> DataFrame:
    """The counts, the digest of the item_ids, and the verdict."""
    names = F.array_sort(F.transform(F.filter("items", lambda i: i.isNotNull()), lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(F.filter("items", lambda i: i.isNotNull())).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )

