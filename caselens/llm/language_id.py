"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams of lower-cased letters (anything else is a blank) are summed per language over all training
documents. The log-probability matrix, buckets times languages, is broadcast: its size is fixed by the number of buckets and of
languages, not by the data. Batches of documents are scored in numpy by looking their n-grams up in the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm import words as W
from caselens.llm.chars import code_points, letter_table, lower_table
from caselens.llm.tables import fold

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
UNKNOWN = "und"
#: Bytes of text whose n-grams are in memory at once.
PIECE = 1 << 19


def ngrams(data: np.ndarray, at: np.ndarray, buckets: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of each n-gram that holds a letter, and whether each row has a letter."""
    points, at = code_points(data, at)
    letters = letter_table()[points]
    chars = np.where(letters, lower_table()[points], 32).astype(np.uint64)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found, where = [], []
    for n in orders:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        key = np.full(m, n, dtype=np.uint64)
        some = np.zeros(m, dtype=bool)
        for i in range(n):
            key = key * np.uint64(0x110001) + chars[i : i + m]
            some |= letters[i : i + m]
        some &= rows[:m] == rows[n - 1 :]
        found.append((W.mix(key[some]) % np.uint64(buckets)).astype(np.int64))
        where.append(rows[:m][some])
    any_letter = np.bincount(rows[letters], minlength=len(at) - 1) > 0
    none = np.zeros(0, np.int64)
    return np.concatenate(found or [none]), np.concatenate(where or [none]), any_letter


def fit(docs: DataFrame, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their log-probability matrix (buckets + 1 rows; the last is the log prior) from text and lang.

    Rows with a null text or lang teach nothing. The driver receives one row per language and bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            data, at = W.text_bytes(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for first, end, part, offsets in W.chunks(data, at, PIECE):
                bucket, row, _ = ngrams(part, offsets, buckets, orders)
                for lang in set(langs[first:end]):
                    own = langs[first:end] == lang
                    total = counts.setdefault(lang, np.zeros(buckets + 1, dtype=np.int64))
                    total[:buckets] += np.bincount(bucket[own[row]], minlength=buckets)
                    total[buckets] += own.sum()
        for lang, total in counts.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some])], ["lang", "bucket", "n"])

    known = docs.select("text", "lang").where("text is not null and lang is not null")
    rows = known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((buckets + 1, len(langs)))
    counts[rows["bucket"].to_numpy(), rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int)] = rows["n"]
    if not langs:
        return [], counts
    body = counts[:-1] + SMOOTHING
    return langs, np.log(np.vstack([body / body.sum(axis=0), counts[-1:] / counts[-1:].sum()])).astype(np.float32)


def _columns(matrix: np.ndarray) -> list[np.ndarray]:
    """The log-probabilities of each language, without the prior."""
    return [np.ascontiguousarray(matrix[:-1, j], dtype=np.float64) for j in range(matrix.shape[1])]


def _predicted(batch: pa.RecordBatch, langs: list[str], matrix: np.ndarray, columns: list[np.ndarray], orders: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, language, posterior) of runs of rows."""
    data, at = W.text_bytes(batch.column("text"))
    for first, end, part, offsets in W.chunks(data, at, PIECE):
        bucket, row, some = ngrams(part, offsets, len(matrix) - 1, orders)
        names, scores = np.full(end - first, UNKNOWN, dtype=object), np.zeros(end - first)
        if langs:
            total = np.stack([np.bincount(row, weights=c[bucket], minlength=end - first) for c in columns], axis=1) + matrix[-1]
            odds = np.exp(total - total.max(axis=1, keepdims=True))
            names[some] = np.array(langs, dtype=object)[total.argmax(axis=1)][some]
            scores[some] = (odds.max(axis=1) / odds.sum(axis=1))[some]
        yield first, end, names, scores


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """doc_id, lang_pred, score per row. Texts that are null or hold no letter get ``und`` and score 0, as do all texts if no
    language was learned; ties go to the first language in the alphabet; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _columns(shared.value)
        for batch in batches:
            for first, end, names, scores in _predicted(batch, langs, shared.value, columns, orders):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def detect(docs: DataFrame, held_out: int = 1, parts: int = 3) -> DataFrame:
    """Fit on the rows outside the fold, predict all: doc_id, held_out, lang_pred, score."""
    langs, matrix = fit(docs.where(fold("doc_id", parts) != held_out))
    return predict(docs, langs, matrix).select("doc_id", (fold("doc_id", parts) == held_out).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """All columns of the rows whose language is recognised: not ``und``, and a posterior of ``least`` or more.

    The model is fitted on the same documents. Each row is judged by its own text, whatever its doc_id, and no row is shuffled.
    """
    langs, matrix = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _columns(shared.value)
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for first, end, names, scores in _predicted(batch, langs, shared.value, columns, ORDERS):
                good[first:end] = (names != UNKNOWN) & (scores >= least)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
