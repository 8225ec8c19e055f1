"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are counted in numpy. Trees are grown on a bounded sample of labelled rows from histograms of binned
statistics, then flattened into arrays (feature, bound, children, value), which all rows of a batch walk down together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm import words as W
from caselens.llm.tables import bounded_sample, fold

#: Labelled rows that are fitted at most.
SAMPLE = 40_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
RIDGE = 5.0
THRESHOLD = 0.7

FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digits", "ascii_punctuation", "marks", "non_ascii", "lines_per_word",
    "short_words", "long_words", "distinct_words", "commonest_word", "distinct_pairs", "distinct_shingles", "words_with_mark", "blanks", "first_pair_repeats",
    "line_repeats",
)


def _classes() -> dict[str, np.ndarray]:
    code = np.arange(256)
    inside = lambda chars: np.isin(code, list(chars))
    return {
        "upper": (code >= 65) & (code <= 90),
        "digits": (code >= 48) & (code <= 57),
        "ascii_punctuation": inside(b".,;:!?'\"()-"),
        "marks": inside(b"!#$%&*|@^~<>{}[]\\/_=+`"),
        "non_ascii": code >= 192,
        "blanks": W.BLANK,
    }


CLASSES = _classes()


def _repeats(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the commonest value of each row."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    starts = np.flatnonzero(fresh)
    length = np.diff(np.append(starts, len(v)))
    most = np.zeros(rows)
    np.maximum.at(most, r[starts], length)
    return np.bincount(r[starts], minlength=rows).astype(float), most


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text; shares of nothing are 0."""
    rows = len(at) - 1
    size = np.diff(at).astype(float)
    part = lambda x, y: np.divide(x, y, out=np.zeros(rows), where=y > 0)
    count = {k: W.segment_sums(c[data].astype(np.int64), at).astype(float) for k, c in CLASSES.items()}
    low = W.LOWER[data]
    start, end, row = W.word_spans(low, at)
    hashes = W.span_hashes(low, start, end) if len(start) else np.zeros(0, np.uint64)
    n = np.bincount(row, minlength=rows).astype(float)
    length = (end - start).astype(float)
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)
    distinct, most = _repeats(hashes, row, rows)
    pairs, pair_row = W.shingles(hashes, row, rows, 2)
    distinct_pairs, most_pairs = _repeats(pairs, pair_row, rows)
    five, five_row = W.shingles(hashes, row, rows, 5)
    distinct_five, _ = _repeats(five, five_row, rows)
    marked = np.concatenate([[0], np.cumsum(CLASSES["marks"][low])])
    breaks = data == 10
    line = np.concatenate([[0], np.cumsum(breaks)])
    line_start = np.union1d(at[:-1][size > 0], np.flatnonzero(breaks) + 1)
    line_start = line_start[line_start < len(data)]
    line_row = np.searchsorted(at, line_start, side="right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(data)), at[line_row + 1]) if len(line_start) else line_start
    lines, _ = _repeats(W.span_hashes(low, line_start, line_end) if len(line_start) else np.zeros(0, np.uint64), line_row, rows)
    n_lines = np.bincount(line_row, minlength=rows).astype(float)
    columns = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(n), "word_length": part(np.bincount(row, length, minlength=rows), n), "longest_word": np.log1p(longest),
        "lines_per_word": part((line[at[1:]] - line[at[:-1]]).astype(float), n), "short_words": part(np.bincount(row, length <= 3, minlength=rows), n),
        "long_words": part(np.bincount(row, length > 12, minlength=rows), n), "distinct_words": part(distinct, n), "commonest_word": part(most, n),
        "distinct_pairs": part(distinct_pairs, np.bincount(pair_row, minlength=rows).astype(float)), "distinct_shingles": part(distinct_five, np.bincount(five_row, minlength=rows).astype(float)),
        "words_with_mark": part(np.bincount(row, marked[end] > marked[start], minlength=rows), n), "first_pair_repeats": np.log1p(most_pairs), "line_repeats": part(lines, n_lines),
    } | {k: part(c, size) for k, c in count.items()}
    return np.stack([columns[k] for k in FEATURES], axis=1)


@dataclass
class Forest:
    """Flat trees: node i of all trees; a leaf's children are itself."""

    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.bound[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Forest:
    """Boosted trees for 0/1 labels. No rows, or one class only, give the share of class 1 (a half without rows)."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
    forest = Forest(*(np.zeros(0) for _ in range(6)), start=float(np.log(share / (1 - share))), depth=depth)
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        flat = binned + np.arange(x.shape[1]) * bins
        total = np.full(len(y), forest.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            grad, hess = p - y, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([0, 0.0, roots[-1], roots[-1], 0.0])
            open_ = [(roots[-1], np.arange(len(y)), 0)]
            while open_:
                at, members, level = open_.pop()
                g, h = grad[members].sum(), hess[members].sum()
                best = (1e-6, -1, 0)
                if level < depth and len(members) >= 20:
                    keys = flat[members].ravel()
                    many = x.shape[1]
                    gs = np.bincount(keys, np.repeat(grad[members], many), minlength=many * bins).reshape(many, bins).cumsum(axis=1)[:, :-1]
                    hs = np.bincount(keys, np.repeat(hess[members], many), minlength=many * bins).reshape(many, bins).cumsum(axis=1)[:, :-1]
                    gain = gs**2 / (hs + RIDGE) + (g - gs) ** 2 / (h - hs + RIDGE) - g**2 / (h + RIDGE)
                    gain[(hs < 1) | (h - hs < 1)] = 0
                    j, b = np.unravel_index(gain.argmax(), gain.shape)
                    if b < len(cuts[j]):
                        best = max(best, (float(gain[j, b]), int(j), int(b)))
                if best[1] < 0:
                    nodes[at][4] = -rate * g / (h + RIDGE)
                    total[members] += nodes[at][4]
                    continue
                _, j, b = best
                goes = binned[members, j] <= b
                left, right = len(nodes), len(nodes) + 1
                nodes += [[0, 0.0, left, left, 0.0], [0, 0.0, right, right, 0.0]]
                nodes[at][:4] = [j, float(cuts[j][b]), left, right]
                open_ += [(left, members[goes], level + 1), (right, members[~goes], level + 1)]
    table = np.array(nodes, dtype=float).reshape(-1, 5)
    forest.feature, forest.left, forest.right = (table[:, k].astype(np.int64) for k in (0, 2, 3))
    forest.bound, forest.value, forest.roots = table[:, 1], table[:, 4], np.array(roots, dtype=np.int64)
    return forest


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    data, at = W.text_bytes(batch.column("text"))
    for first, end, part, offsets in W.chunks(data, at):
        yield first, end, statistics(part, offsets)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Forest:
    """Trees from at most ``rows`` labelled documents, those with the smallest hashes of doc_id; only their statistics reach the driver.

    Labels other than 0 and 1 teach nothing. Of repeated labels of a document the greatest counts, of repeated documents one.
    """
    marks = labels.select("doc_id", "quality").where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = bounded_sample(marks.join(docs.select("doc_id").distinct(), "doc_id"), "doc_id", rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, x in _rows(batch):
                ids, marks = (batch.column(c).slice(first, end - first) for c in ("doc_id", "quality"))
                yield pa.RecordBatch.from_arrays([ids, marks, *(pa.array(x[:, j]) for j in range(len(FEATURES)))], ["doc_id", "quality", *FEATURES])

    schema = "doc_id long, quality int, " + ", ".join(f"{f} double" for f in FEATURES)
    # ``rows`` bounds the ids: no text is shuffled to find theirs
    known = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    found = known.mapInArrow(run, schema).dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    return grow(found[list(FEATURES)].to_numpy(dtype=float), found["quality"].to_numpy(dtype=float))


def scores(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted per row; null texts are scored as empty ones; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, x in _rows(batch):
                p = shared.value.probability(x)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame, held_out: int = 2, parts: int = 4) -> DataFrame:
    """Learn from the labels outside the fold, score all: doc_id, held_out, score, predicted."""
    forest = fit(docs.where(fold("doc_id", parts) != held_out), labels)
    return scores(docs, forest).select("doc_id", (fold("doc_id", parts) == held_out).alias("held_out"), "score", "predicted")
