"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary and one of toxic text.

Both begin with a dictionary trained on windows of ordinary documents; the toxic one goes on with a dictionary trained on toxic
windows, cut to the words that toxic documents use more than ordinary ones (a word counts once per pair of neighbours, so that copies
add nothing). So a window is compressed alike by both unless toxic
text makes it shorter. A document's evidence is how many bytes that saves: the largest saving of a window, and how many windows
save much. Half of the labelled sample trains dictionaries of several strengths; the other half picks one and calibrates: a logistic
curve over the evidence and the number of windows gives the score, 0.5 is the threshold.

The dictionaries and the curve (some KB) are broadcast; every window of every text is compressed.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm.tables import bounded_sample, fold

#: Words per window.
WINDOW = 6
LEVEL = 3
BASE_BYTES = 4096
#: Labelled rows of each class that are fitted at most.
SAMPLE = 1500
#: (least uses of a word per toxic document, bytes of the toxic dictionary, its segments' size): the strengths tried.
STRENGTHS = ((0.01, 2048, 16), (0.02, 2048, 16), (0.03, 1024, 16), (0.03, 2048, 24), (0.06, 1024, 16), (0.06, 512, 24), (0.12, 512, 16))
#: Bytes saved by a window that count as much: the thresholds tried.
MUCH = (2, 3, 4, 5)
LETTERS = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Runs of ``size`` words (letters only, lower case) of the whole text, a blank between and at either end; none without words."""
    words = LETTERS.findall((text or "").lower().encode("utf-8", "surrogatepass"))
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]
    much: int = MUCH[0]

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return _compressor(self.ordinary), _compressor(self.toxic)


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False)


def _trained(size: int, samples: list[bytes], segment: int = 0) -> bytes:
    """A trained dictionary; where there is too little text to train one, the samples' end."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6 if segment else 0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def savings(text: str | None, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> list[int]:
    """Bytes that the toxic dictionary saves in each window."""
    return [len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text)]


def evidence(saved: list[int], much: int) -> list[float]:
    """[1, largest saving, log of windows that save much, log of windows]."""
    return [1.0, float(min(max(saved, default=0), 16)), math.log1p(sum(x >= much for x in saved)), math.log1p(len(saved))]


def _curve(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps; a row counts ``counts`` times."""
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (counts * (y - p)) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str | None], toxic: list[int], keys: list[int], totals: tuple[int, int] | None = None) -> Model:
    """The model from labelled texts. ``keys`` (ids) deal them into the training and the calibration half.

    ``totals``: labelled rows of class 0 and 1 that the texts stand for (by default the texts themselves). Calibration rows are
    weighted so that the classes have these shares, whatever part of each class was taken.
    Repeated texts count once. With one class only, the score is that class's share everywhere.
    """
    whole = totals or (toxic.count(0), toxic.count(1))
    rows = list({t: (t, int(y), zlib.crc32(f"half{k}".encode()) % 2) for t, y, k in sorted(zip(texts, toxic, keys, strict=True), key=lambda r: -r[2]) if t and t.strip()}.values())
    train, rest = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    if len({r[1] for r in train}) < 2 or len({r[1] for r in rest}) < 2:
        share = min(max(whole[1] / sum(whole) if rows else 0.0, 1e-6), 1 - 1e-6)
        return Model(b" ", b" ", [math.log(share / (1 - share)), 0.0, 0.0, 0.0])
    used: list[Counter] = [Counter(), Counter()]
    sizes = [0, 0]
    met: list[set] = [set(), set()]
    for text, label, _ in train:
        words = LETTERS.findall(text.lower().encode("utf-8", "surrogatepass"))
        met[label].update(zip([b"", *words], words, [*words[1:], b""], strict=False))
        sizes[label] += 1
    for label in (0, 1):
        used[label].update(w for _, w, _ in met[label])
    ratio = {w: (n + 0.5) / (sizes[1] + 1) / ((used[0][w] + 0.5) / (sizes[0] + 1)) for w, n in used[1].items() if n >= 3 and len(w) >= 3}
    ordinary = _trained(BASE_BYTES, [w for t, y, _ in train if not y for w in windows(t)])
    y = np.array([r[1] for r in rest], dtype=float)
    counts = np.where(y == 1, whole[1] / y.sum(), whole[0] / (1 - y).sum()) * len(y) / sum(whole)
    best: tuple[float, Model] | None = None
    for share, size, segment in STRENGTHS:
        marked = {w for w, r in ratio.items() if r > 10 and used[1][w] >= share * sizes[1]}
        cut = [[x for x in w.split(b" ") if x in marked] for t, label, _ in train if label for w in windows(t)]
        samples = [b" " + b" ".join(c) + b" " for c in cut if c]
        model = Model(ordinary, ordinary + (_trained(size, samples, segment) if samples else b""), [])
        pair = model.compressors()
        saved = [savings(t, *pair) for t, _, _ in rest]
        for much in MUCH:
            x = np.array([evidence(v, much) for v in saved])
            curve = _curve(x, y, counts)
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ curve, -30, 30))), 1e-9, 1 - 1e-9)
            loss = float(-(counts * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())
            if best is None or loss < best[0]:
                best = (loss, Model(model.ordinary, model.toxic, curve.tolist(), much))
    return best[1]


def fit_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """Fit on at most ``rows`` labelled documents of either class, those with the smallest hashes of doc_id, with their whole texts;
    the curve is calibrated to the classes' shares of all labelled documents.

    Labels other than 0 and 1 teach nothing. Of repeated labels of a document the greatest counts.
    """
    marks = labels.select("doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = marks.join(docs.select("doc_id").distinct(), "doc_id")
    totals = dict(known.groupBy("toxic").count().collect())
    ids = bounded_sample(known.where("toxic = 1"), "doc_id", rows).union(bounded_sample(known.where("toxic = 0"), "doc_id", rows))
    found: pd.DataFrame = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).toPandas()
    return fit(found["text"].tolist(), found["toxic"].tolist(), found["doc_id"].tolist(), (totals.get(0, 0), totals.get(1, 0)))


def _scored(batch: pa.RecordBatch, model: Model, pair: tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]) -> np.ndarray:
    w = np.array(model.weights)
    x = np.array([evidence(savings(t.as_py(), *pair), model.much) for t in batch.column("text")]).reshape(-1, len(w))
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted (1 from 0.5 on) per row; null and empty texts get the curve's value for no window."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = shared.value.compressors()
        for batch in batches:
            p = _scored(batch, shared.value, pair)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame, held_out: int = 0, parts: int = 5) -> DataFrame:
    """Learn from the labels outside the fold, score all: doc_id, held_out, score, predicted."""
    model = fit_rows(docs.where(fold("doc_id", parts) != held_out), labels)
    return scores(docs, model).select("doc_id", (fold("doc_id", parts) == held_out).alias("held_out"), "score", "predicted")


def civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of the rows that aren't predicted toxic. Each row is judged by its own text, whatever its doc_id, and no row is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_rows(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = shared.value.compressors()
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch, shared.value, pair) < 0.5))

    return docs.mapInArrow(run, docs.schema)
