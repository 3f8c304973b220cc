"""Ranked lexical search over a length-stratified index.

A document's normaliser m is 75 + (25 * n * N) div L, for its n terms, N documents with terms and L terms in all.
Documents with equal m form a stratum. Inside a stratum postings are grouped by term and tf, so what a posting adds to
a score, its impact (10^9 * tf) div (1000 * tf + 12 * m), is computed once for each (term, tf) and not once per
document. A stratum is dealt by row into blocks of about ``BLOCK_POSTINGS`` postings, so one with a third of all rows
spreads over tasks. A block's documents are numbered inside it; the row of the empty term lists their doc_ids.

A search takes the queries in blocks of bounded size. The largest tf of each term in a stratum bounds the scores there.
The strata of an item are visited by falling bound: first those that hold ``FIRST_DOCS`` documents between them, which
gives the k-th best score so far; then, of the others, those whose bound reaches it. Blocks are held
against their own, tighter bound, and a task raises the mark with what it finds. Bounds prune, they never cut: every
document that could be among the k best is scored.

Scores are sums over the query's terms, repeats included, of w * impact with w = floor(1000 * ln((2N + 2) / (2df + 1))).
Ties go by doc_id, smallest first, null last. Defined results: terms are runs of ASCII letters, digits and of characters
beyond ASCII, A-Z lower-cased. A null or wordless text has no terms, is not counted in N and never found; a null or
wordless query has no result, neither has any query of an empty table. Very long texts are counted whole; one may be larger than
a block. Repeated rows are documents of their own, each counted and ranked; queries are answered row by row, and rows with
equal item_id each get their ranks. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cuesheet.llm.common import BATCH_ROWS, map_batches
from cuesheet.llm.decontaminate import words_of
from cuesheet.plans.session import stage

TOP = 20
BLOCK_POSTINGS, FIRST_DOCS = 200_000, 2_000
#: Queries of one pass: at most so many cells of the matrices (query, distinct term) and (query, first visit).
QUERY_CELLS = 4_000_000
#: Tables of strata are sent to all tasks up to so many rows; more are joined by a shuffle.
BROADCAST_STRATA = 200_000
#: Rows of postings that travel to Python at once.
POSTING_ROWS = 4096

_KEY = "m long, block long"


class Index(NamedTuple):
    """postings (m, block, term, tf, docs), terms (term, df), strata (m, n_docs), and the totals."""

    postings: DataFrame
    terms: DataFrame
    strata: DataFrame
    n_docs: int
    n_terms: int


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term; terms are distinct."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [Counter(words_of(text)) for text in batch.column("text").to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, counted)]), pa.int32())
            words = pa.array(list(chain.from_iterable(counted)), pa.binary()).cast(pa.string(), safe=False)
            times = np.fromiter(chain.from_iterable(c.values() for c in counted), np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([sum(c.values()) for c in counted], pa.int64()),
                 pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(times))],
                names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    return map_batches(rows, run, "doc_id long, n long, terms array<string>, tfs array<int>").filter("n > 0")


def build_index(docs: DataFrame, block_postings: int = BLOCK_POSTINGS) -> Index:
    """Counts terms once, writes that table, and deals it to strata."""
    counted = stage(term_counts(docs).withColumn("row", F.monotonically_increasing_id()), "terms")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    strata_of = counted.withColumn(
        "m", F.expr(f"75L + (25 * cast(n as decimal(18, 0)) * {n_docs}BD) div {max(n_terms, 1)}BD").cast("long"))
    strata = stage(strata_of.groupBy("m").agg(F.count("*").alias("n_docs"), F.sum(F.size("terms")).alias("n_postings")), "strata")
    dealt = strata_of.join(_sent(strata.select("m", F.ceil(F.col("n_postings") / block_postings).alias("blocks"))), "m")
    dealt = dealt.select("m", F.pmod(F.xxhash64("row"), "blocks").alias("block"), "doc_id", "row", "terms", "tfs")
    postings = stage(_postings(dealt), "postings")
    terms = stage(postings.filter("term <> ''").groupBy("term").agg(F.sum(F.size("docs")).alias("df")), "dictionary")
    return Index(postings, terms, strata.select("m", "n_docs"), n_docs, n_terms)


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_STRATA else table


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """The rows of each (m, block) from batches that are sorted by it."""
    open_rows: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        m, block = batch.column("m").to_numpy(), batch.column("block").to_numpy()
        edges = np.flatnonzero((np.diff(m) != 0) | (np.diff(block) != 0)) + 1
        for first, after in zip([0, *edges], [*edges, batch.num_rows]):
            if first == after:
                continue
            key = (int(m[first]), int(block[first]))
            if key != at and open_rows:
                yield *at, pa.Table.from_batches(open_rows)
                open_rows = []
            at = key
            open_rows.append(batch.slice(first, after - first))
    if open_rows:
        yield *at, pa.Table.from_batches(open_rows)


def _postings(dealt: DataFrame) -> DataFrame:
    """(m, block, term, tf, docs): postings by tf of each block, and one row of the empty term with its doc_ids."""
    kinds = pa.schema([("m", pa.int64()), ("block", pa.int64()), ("term", pa.string()), ("tf", pa.int32()), ("docs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, block, rows in _runs(batches):
            terms, tfs = rows["terms"].combine_chunks(), rows["tfs"].combine_chunks()
            coded = terms.flatten().dictionary_encode()
            codes, times = coded.indices.to_numpy(), tfs.flatten().to_numpy()
            place = np.repeat(np.arange(len(rows)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            order = np.lexsort((place, times, codes))
            codes, times, place = codes[order], times[order], place[order]
            first = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(times, prepend=-1) != 0))
            ends = pa.array(np.append(first, len(codes)), pa.int32())
            names, ids = rows["doc_id"].combine_chunks(), pa.array([0, len(rows)], pa.int32())
            made = pa.Table.from_arrays([
                pa.chunked_array([pa.array([m] * (len(first) + 1), pa.int64())]), pa.chunked_array([pa.array([block] * (len(first) + 1), pa.int64())]),
                pa.chunked_array([pa.array([""], pa.string()), coded.dictionary.take(pa.array(codes[first]))]),
                pa.chunked_array([pa.array([0], pa.int32()), pa.array(times[first], pa.int32())]),
                pa.chunked_array([pa.ListArray.from_arrays(ids, names), pa.ListArray.from_arrays(ends, pa.array(place, pa.int64()))]),
            ], schema=kinds)
            yield from made.combine_chunks().to_batches(max_chunksize=POSTING_ROWS)

    # rows of a block in one order, so that a task that runs again numbers them alike
    rows = dealt.repartition("m", "block").sortWithinPartitions("m", "block", "row").select("m", "block", "doc_id", "terms", "tfs")
    return map_batches(rows, run, f"{_KEY}, term string, tf int, docs array<long>")


class _Queries(NamedTuple):
    """One block of queries: vocab codes terms, parts has (code, weight times repeats) arrays of each item."""

    item_ids: list[int | None]
    vocab: list[str]
    parts: list[tuple[np.ndarray, np.ndarray]]


def _query_blocks(queries: DataFrame, cells: int, first_docs: int) -> Iterator[tuple[list[int | None], list[Counter]]]:
    ids: list[int | None] = []
    counts: list[Counter] = []
    vocab: set[bytes] = set()
    for item_id, text in queries.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        found = Counter(words_of(text))
        if not found:
            continue
        if ids and (len(ids) + 1) * max(len(vocab | found.keys()), first_docs) > cells:
            yield ids, counts
            ids, counts, vocab = [], [], set()
        ids.append(item_id)
        counts.append(found)
        vocab |= found.keys()
    if ids:
        yield ids, counts


def _weighted(index: Index, ids: list[int | None], counts: list[Counter]) -> _Queries:
    spark = index.terms.sparkSession
    words = sorted({w.decode("utf-8", "surrogatepass") for c in counts for w in c})
    # the words of one bounded block of queries
    wanted = F.broadcast(spark.createDataFrame([(w,) for w in words], "term string"))
    df = {r["term"]: r["df"] for r in index.terms.join(wanted, "term").collect()}
    vocab = [w for w in words if w in df]
    code = {w.encode("utf-8", "surrogatepass"): n for n, w in enumerate(vocab)}
    weight = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df[w] + 1))) for w in vocab], np.int64)
    parts = []
    for c in counts:
        known = [w for w in c if w in code]
        at = np.array([code[w] for w in known], np.int64)
        parts.append((at, weight[at] * np.array([c[w] for w in known], np.int64) if known else at))
    return _Queries(ids, vocab, parts)


def _bounds(index: Index, postings: DataFrame, queries: _Queries) -> DataFrame:
    """(item, m, bound, n_docs) of every stratum that holds a term of the item."""
    spark = postings.sparkSession
    rows = [(item, queries.vocab[c], int(w)) for item, (codes, weights) in enumerate(queries.parts) for c, w in zip(codes, weights) if w > 0]
    # one bounded block of queries
    asked = F.broadcast(spark.createDataFrame(rows, "item long, term string, weight long"))
    tops = postings.groupBy("m", "term").agg(F.max("tf").cast("long").alias("tf"))
    impact = F.expr("weight * ((1000000000 * tf) div (1000 * tf + 12 * m))")
    bounds = tops.join(asked, "term").groupBy("item", "m").agg(F.sum(impact).alias("bound"))
    return bounds.filter("bound > 0").join(_sent(index.strata), "m")


def _scored(postings: DataFrame, queries: _Queries, marks: np.ndarray, visits: dict[int, np.ndarray], only_visits: bool, top: int) -> DataFrame:
    """(item, doc_id, score): the best ``top`` of each item in each task, none below the item's mark. ``visits`` lists items
    by stratum: either only those are scored, or all but those."""
    sent = postings.sparkSession.sparkContext.broadcast((queries.vocab, queries.parts, marks, visits))
    kinds = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    nobody = np.zeros(0, np.int64)
    last = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, parts, marks, visits = sent.value
        names = pa.array(vocab, pa.string())
        weights = np.zeros((len(parts), len(vocab)), np.int64)
        for item, (codes, weight) in enumerate(parts):
            weights[item, codes] = weight
        marks = np.maximum(marks, 1)
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m, _, rows in _runs(batches):
            listed = visits.get(m, nobody)
            if only_visits and not len(listed):
                continue
            terms, docs = rows["term"].combine_chunks(), rows["docs"].combine_chunks()
            head = pc.index(terms, "").as_py()
            lengths = pc.list_value_length(docs).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            members = docs.flatten().slice(int(ends[head] - lengths[head]), int(lengths[head]))
            missing = members.is_null().to_numpy(zero_copy_only=False)
            ids = members.fill_null(last).to_numpy()
            places = docs.flatten().fill_null(0).to_numpy()
            tf = rows["tf"].to_numpy().astype(np.int64)
            impacts = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
            spread = np.repeat(impacts, lengths)
            codes = pc.index_in(terms, value_set=names).fill_null(-1).to_numpy()
            tops = np.zeros(len(vocab), np.int64)
            np.maximum.at(tops, codes[codes >= 0], impacts[codes >= 0])
            # rows of one term stand together
            first = np.flatnonzero(np.diff(codes, prepend=-2))
            after = np.append(first[1:], len(codes))
            slices = {int(codes[a]): slice(int(ends[a] - lengths[a]), int(ends[b - 1])) for a, b in zip(first, after) if codes[a] >= 0}
            hopeful = weights @ tops >= marks
            if only_visits:
                chosen = listed[hopeful[listed]]
            else:
                hopeful[listed] = False
                chosen = np.flatnonzero(hopeful)
            for item in chosen.tolist():
                scores = np.zeros(len(ids), np.int64)
                for code, weight in zip(*(x.tolist() for x in parts[item])):
                    if code in slices:
                        at = slices[code]
                        scores[places[at]] += weight * spread[at]
                good = np.flatnonzero(scores >= marks[item])
                if not len(good):
                    continue
                found = (scores[good], missing[good], ids[good])
                if item in best:
                    found = tuple(np.concatenate(x) for x in zip(best[item], found))
                order = np.lexsort((found[2], found[1], -found[0]))[:top]
                best[item] = found = tuple(x[order] for x in found)
                if len(order) == top:
                    marks[item] = max(marks[item], found[0][-1])
        if best:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(list(best), [len(x[0]) for x in best.values()]), pa.int64()),
                pa.array(np.concatenate([x[2] for x in best.values()]), pa.int64(), mask=np.concatenate([x[1] for x in best.values()])),
                pa.array(np.concatenate([x[0] for x in best.values()]), pa.int64())], schema=kinds)

    rows = postings.repartition("m", "block").sortWithinPartitions("m", "block", "term", "tf")
    return map_batches(rows, run, "item long, doc_id long, score long", POSTING_ROWS)


def _search_block(index: Index, queries: _Queries, top: int, first_docs: int) -> DataFrame:
    spark = index.postings.sparkSession
    # the words of one bounded block of queries, and the empty one that lists a block's documents
    wanted = F.broadcast(spark.createDataFrame([("",), *((w,) for w in queries.vocab)], "term string"))
    postings = index.postings.join(wanted, "term", "left_semi").select("m", "block", "term", "tf", "docs")
    bounds = stage(_bounds(index, postings.filter("term <> ''"), queries), "bounds")
    before = F.expr("coalesce(sum(n_docs) over (partition by item order by bound desc, m rows between unbounded preceding and 1 preceding), 0)")
    early = bounds.select("item", "m", before.alias("before")).filter(F.col("before") < first_docs)
    visits: dict[int, list[int]] = {}
    for item, m in early.select("item", "m").collect():  # at most first_docs strata for each item of a bounded block
        visits.setdefault(m, []).append(item)
    lists = {m: np.array(sorted(items)) for m, items in visits.items()}
    marks = np.zeros(len(queries.parts), np.int64)
    visited = F.broadcast(spark.createDataFrame([(m,) for m in lists], "m long"))
    found = stage(_scored(postings.join(visited, "m", "left_semi"), queries, marks, lists, True, top), "first")
    ranked = _best(found, "item", top)
    for item, score in ranked.filter(F.col("rank") == top).select("item", "score").collect():
        marks[item] = score
    # strata that some item has not seen and whose bound reaches that item's mark
    reach = F.broadcast(spark.createDataFrame(list(enumerate(marks.tolist())), "item long, mark long"))
    seen = early.select("item", "m")
    open_strata = bounds.join(reach, "item").filter("bound >= mark").join(F.broadcast(seen), ["item", "m"], "left_anti").select("m").distinct()
    rest = postings.join(_sent(stage(open_strata, "open")), "m", "left_semi")
    return stage(found.unionByName(_scored(rest, queries, marks, lists, False, top)), "found")


def _best(found: DataFrame, key: str, top: int) -> DataFrame:
    place = F.expr(f"row_number() over (partition by {key} order by score desc, doc_id asc nulls last)")
    return found.withColumn("rank", place).filter(F.col("rank") <= top)


def search(index: Index, queries: DataFrame, top: int = TOP, first_docs: int = FIRST_DOCS, cells: int = QUERY_CELLS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents with a score above 0 for each row of ``queries``."""
    spark = queries.sparkSession
    parts: DataFrame | None = None
    for ids, counts in _query_blocks(queries, cells, first_docs):
        asked = _weighted(index, ids, counts)
        if not any((weights > 0).any() for _, weights in asked.parts):
            continue
        found = _best(_search_block(index, asked, top, first_docs), "item", top)
        names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), "item long, item_id long"))  # one bounded block
        part = found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        parts = part if parts is None else parts.unionByName(part)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if parts is None else parts
