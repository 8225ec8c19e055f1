"""Ranked lexical search: best-first document intervals bounded by range maxima.

The index is a table of segments, each of some megabytes of text from one task: the ids and lengths of its documents, and for each
term its posting list (document numbers and occurrences). Nothing is shuffled to build it. Within a segment documents with the same
most frequent term stand together, short ones first, so that neighbours in number are alike.

A search scores a block of queries segment by segment. The impacts of the postings that the block asks for are set out list by list
under one sparse table of range maxima: the greatest impact of a list between any two postings takes two look-ups. A query begins with the
interval of all documents. The interval with the highest bound (the sum of its terms' weighted range maxima) is split at its document of the greatest
single contribution, which is scored in full, and both sides get their own bounds. Intervals below the k-th best score so far are
never opened; those equal to it are, as ties go by doc_id. Intervals are opened ``AHEAD`` at a time.

One segment in 16 is searched first: its k-th best scores are thresholds for all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.functions.numbering import top_per_key
from caselens.functions.scratch import written
from caselens.llm import words as W

#: Bytes of text in a segment; a longer text is a segment of its own.
SEGMENT = 1 << 23
#: Pairs of query and term that are broadcast at a time (24 bytes each).
PAIRS = 500_000
#: Intervals that are opened at once.
AHEAD = 32
#: Postings whose range maxima are made at once.
STRETCH = 1 << 16
#: Segments in a file of the index: whoever reads a file may hold all its rows at once.
FILE_ROWS = 1
#: One in so many segments is searched first.
FIRST = 16
#: Bytes outside terms: ASCII but for digits and letters.
OUTSIDE = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
INDEX = "segment long, total long, doc_ids array<long>, lengths array<int>, terms array<long>, sizes array<int>, docs array<int>, tfs array<int>"


def term_hashes(column: pa.Array) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, hash of every term, its row) of runs of rows."""
    data, at = W.text_bytes(column)
    for first, end, part, offsets in W.chunks(data, at):
        low = W.LOWER[part]
        start, stop, row = W.word_spans(low, offsets, OUTSIDE)
        yield first, end, len(part), W.span_hashes(low, start, stop).view(np.int64), row


def counted(*keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct tuples in order of the first key, then the next, and how often each occurs."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(fresh)
    return *(k[at] for k in keys), np.diff(np.append(at, len(order)))


def segment(number: int, ids: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> pa.RecordBatch | None:
    """A row of the index. Documents without terms are left out."""
    if not len(hashes):
        return None
    doc, term, tf = counted(doc, hashes)
    some, length = np.unique(doc), np.bincount(doc, tf).astype(np.int64)
    best = np.lexsort((term, -tf, doc))[np.searchsorted(doc, some)]  # of each document, its most frequent term
    some = some[np.lexsort((length[some], term[best]))]
    rank = np.zeros(len(ids), np.int64)
    rank[some] = np.arange(len(some))
    order = np.lexsort((rank[doc], term))
    terms, sizes = np.unique(term, return_counts=True)
    lists = [ids[some], length[some].astype(np.int32), terms, sizes.astype(np.int32), rank[doc][order].astype(np.int32), tf[order].astype(np.int32)]
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([int(length.sum())], pa.int64()), *map(one, lists)], [x.split()[0] for x in INDEX.split(", ")])


def index(docs: DataFrame) -> DataFrame:
    """Segments of all documents with a doc_id; null texts have no terms. Written to the shared folder by ``search_all``, or by the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        ids, hashes, doc, count, size = [], [], [], 0, 0
        for batch in batches:
            own = batch.column("doc_id").to_numpy()
            for first, end, length, h, row in term_hashes(batch.column("text")):
                ids.append(own[first:end])
                hashes.append(h)
                doc.append(row + count)
                count, size = count + end - first, size + length
                if size >= SEGMENT:
                    if (out := segment(number, *map(np.concatenate, (ids, hashes, doc)))) is not None:
                        yield out
                    ids, hashes, doc, count, size, number = [], [], [], 0, 0, number + 1
        if count and (out := segment(number, *map(np.concatenate, (ids, hashes, doc)))) is not None:
            yield out

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, INDEX)


class Block(NamedTuple):
    """Queries that are searched together: distinct terms with weights, and each query's places among them with repeats."""

    items: list
    terms: np.ndarray
    weights: np.ndarray
    places: list[np.ndarray]
    repeats: list[np.ndarray]
    docs: int
    length: int


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id, term, repeats. Equal rows count once; texts that share an item_id are one query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, _, h, row in term_hashes(batch.column("text")):
                row, term, repeats = counted(row, h)
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(first + row)), pa.array(term), pa.array(repeats)], ["item_id", "term", "repeats"])

    rows = queries.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return rows.mapInArrow(run, "item_id long, term long, repeats long").groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats"))


def blocks(segments: DataFrame, queries: DataFrame) -> Iterator[Block]:
    """All queries, about ``PAIRS`` pairs of query and term at a time, with weights from the whole index."""
    spark = segments.sparkSession
    pairs = written(query_terms(queries), "queries")
    sums = segments.agg(F.sum(F.size("doc_ids").cast("long")).alias("n"), F.sum("total").alias("l")).first()
    if not sums["n"]:
        return
    count = max(1, -(-pairs.count() // PAIRS))
    for k in range(count):
        rows = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).orderBy("item_id", "term").toArrow()
        if not rows.num_rows:
            continue
        item, term, repeats = (rows[c].to_numpy() for c in ("item_id", "term", "repeats"))
        terms, place = np.unique(term, return_inverse=True)
        asked = spark.sparkContext.broadcast(terms)

        def sizes(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, size = (batch.column(c).flatten().to_numpy() for c in ("terms", "sizes"))
                keep = np.isin(own, asked.value)
                yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(size[keep].astype(np.int64))], ["term", "df"])

        found = segments.select("terms", "sizes").mapInArrow(sizes, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(len(terms), np.int64)
        df[np.searchsorted(terms, found["term"].to_numpy())] = found["df"].to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * sums["n"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        items, at = np.unique(item, return_index=True)
        cuts = at[1:]
        yield Block(items.tolist(), terms, weights, np.split(place, cuts), np.split(repeats, cuts), int(sums["n"]), int(sums["l"]))


class Postings:
    """Impacts of a segment's postings of the asked terms, list by list, under a sparse table of range maxima."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, docs: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, block: Block):
        at = np.minimum(np.searchsorted(terms, block.terms), len(terms) - 1)
        held = terms[at] == block.terms
        size = np.where(held, sizes[at], 0).astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[at]
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        take = np.arange(int(size.sum())) - np.repeat(self.starts - begins, size)
        self.width = len(lengths) + 1
        self.docs = docs[take].astype(np.int64)
        self.keys = np.repeat(np.arange(len(size)), size) * self.width + self.docs
        norm = 25 + (75 * lengths.astype(np.int64) * block.docs) // block.length
        tf = tfs[take].astype(np.int64)
        self.impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[self.docs])
        del take, tf, norm
        longest = int(size.max(initial=0))
        self.table = np.empty((max(1, longest.bit_length()), len(self.docs)), np.int32)
        self.table[0] = np.arange(len(self.docs))
        for k in range(1, longest.bit_length()):
            reach, level, made = 1 << (k - 1), self.table[k - 1], self.table[k]
            made[:] = level
            for at in range(0, len(level) - reach, STRETCH):
                left, right = level[at : min(at + STRETCH, len(level) - reach)], level[at + reach : at + reach + STRETCH]
                made[at : at + len(left)] = np.where(self.impacts[right] > self.impacts[left], right, left)

    def maxima(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the greatest impact from start to end, within one list; for empty ranges any place."""
        span = np.maximum(end - start, 1)
        level = np.frexp(span)[1] - 1
        last = len(self.impacts) - 1
        left = self.table[level, np.minimum(start, last)]
        right = self.table[level, np.clip(end - (1 << level), 0, last)]
        return np.where(self.impacts[right] > self.impacts[left], right, left)


def best_documents(postings: Postings, ids: np.ndarray, lists: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, score) of the k best documents with a score of ``floor`` and more, equal ones by doc_id."""
    keep = (postings.ends[lists] > postings.starts[lists]) & (weights > 0)
    lists, weights = lists[keep], weights[keep]
    found_ids, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(lists):
        return found_ids, found

    def bounds(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bound of each interval, and the document that contributes most to it."""
        top = postings.maxima(start, end)
        share = np.where(end > start, postings.impacts[top] * weights, 0)
        most = np.argmax(share, axis=1)
        return share.sum(axis=1), postings.docs[top[np.arange(len(top)), most]]

    start, end = postings.starts[lists][None, :], postings.ends[lists][None, :]
    bound, split = bounds(start, end)
    base = lists * postings.width
    while len(bound):
        some = np.argpartition(-bound, AHEAD)[:AHEAD] if len(bound) > AHEAD else np.arange(len(bound))
        s, e, doc = start[some], end[some], split[some]
        place = np.searchsorted(postings.keys, base + doc[:, None])
        hit = (place < e) & (postings.docs[np.minimum(place, len(postings.docs) - 1)] == doc[:, None])
        score = np.where(hit, postings.impacts[np.minimum(place, len(postings.docs) - 1)] * weights, 0).sum(axis=1)
        good = score >= max(floor, 1)
        found_ids, found = np.append(found_ids, ids[doc[good]]), np.append(found, score[good])
        if len(found) > k:
            order = np.lexsort((found_ids, -found))[:k]
            found_ids, found = found_ids[order], found[order]
        if len(found) == k:
            floor = max(floor, int(found.min()))
        near, far = np.concatenate([s, place + hit]), np.concatenate([place, e])
        inner, at = bounds(near, far)
        keep, fresh = bound >= max(floor, 1), inner >= max(floor, 1)
        keep[some] = False
        start, end = np.concatenate([start[keep], near[fresh]]), np.concatenate([end[keep], far[fresh]])
        bound, split = np.concatenate([bound[keep], inner[fresh]]), np.concatenate([split[keep], at[fresh]])
    return found_ids, found


def search(segments: DataFrame, block: Block, k: int, floors: np.ndarray) -> DataFrame:
    """item_id, doc_id, score: the k best documents of each segment for each query of a block, none below the query's floor."""
    shared = segments.sparkSession.sparkContext.broadcast((block, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, floors = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                part = {name: batch.column(name)[r].values.to_numpy() for name in ("doc_ids", "lengths", "terms", "sizes", "docs", "tfs")}
                postings = None  # the last segment's goes before the next one is made
                postings = Postings(part["terms"], part["sizes"], part["docs"], part["tfs"], part["lengths"], block)
                item, doc, score = [], [], []
                for q, name in enumerate(block.items):
                    weights = block.weights[block.places[q]] * block.repeats[q]
                    ids, scores = best_documents(postings, part["doc_ids"], block.places[q], weights, k, int(floors[q]))
                    item.append(np.full(len(ids), name, np.int64))
                    doc.append(ids)
                    score.append(scores)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (item, doc, score)], ["item_id", "doc_id", "score"])

    return segments.select("doc_ids", "lengths", "terms", "sizes", "docs", "tfs").mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = top_per_key(found, ["item_id"], [F.desc("score"), F.asc("doc_id")], k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search_index(segments: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents that score highest above 0 for each query, equal scores by doc_id.

    ``segments`` is a written ``index``. Queries without an item_id, text or known term have no rows. A repeated row of the documents is
    ranked as often as it was indexed.
    """
    first = F.pmod(F.xxhash64("segment"), F.lit(FIRST)) == 0
    found = segments.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for block in blocks(segments, queries):
        early = written(ranked(search(segments.where(first), block, k, np.zeros(len(block.items), np.int64)), k).drop("rank"), "early")
        least = early.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).toArrow()
        floors = np.zeros(len(block.items), np.int64)
        floors[np.searchsorted(block.items, least["item_id"].to_numpy())] = least["floor"].to_numpy()
        found = found.union(early).union(search(segments.where(~first), block, k, floors))
    return ranked(found, k)


def search_all(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Index all documents in the shared folder, then search; other columns are not read."""
    return search_index(written(index(docs), "segments", FILE_ROWS), queries, k)
