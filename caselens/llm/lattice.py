"""LM scoring by a subword lattice.

The pieces of an existing subword vocabulary, begun at their own scores, get unigram probabilities from the training documents by
expectation maximisation over all segmentations. A text's probability is marginal: the forward recursion in log space sums over
every way to cut its words into pieces (pieces never cross a blank). As words repeat, the recursion runs once per distinct word of
the corpus; words and counts are gathered by Spark, and documents sum their words' log probabilities. The commonest words are
broadcast (a bounded table), the rest joined by word hash.

Beside it stands a base: add-a-half word unigrams from the same counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.scratch import written
from caselens.llm import words as W
from caselens.llm.tables import fold

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that are broadcast at most.
COMMON = 1 << 17
ROUNDS = 2
#: Words of more characters are cut one by one, in stretches of ``STRETCH`` characters.
LONG = 48
STRETCH = 1 << 16
#: Distinct words whose counts a task holds before it hands them on.
HELD = 200_000
#: Words whose lattices are in memory at once.
GROUP = 20_000


@dataclass
class Pieces:
    """Sorted piece hashes with natural log probabilities; the last log probability is an unknown byte's, the one before the end's.

    ``longest`` is the number of characters of the longest piece.
    """

    keys: np.ndarray
    logs: np.ndarray
    longest: int


def vocabulary(path: str = VOCABULARY) -> Pieces:
    """Pieces of a vocabulary file without control pieces, weighted by their scores.

    Scores that are ranks (a merge list has 0, -1, -2, ...) become Zipf weights; others are log probabilities as they are.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names, values = [], []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and "▁" not in name[1:]:
            names.append(name)
            values.append(model.get_score(i))
    score = np.array(values, dtype=float)
    logs = -np.log(2 - score) if score.min() < -1000 else score
    points = np.array([ord(c) for n in names for c in n], dtype=np.uint64)
    at = np.concatenate([[0], np.cumsum([len(n) for n in names])])
    keys = np.zeros(len(names), dtype=np.uint64)
    for i in range(len(names)):
        h = np.uint64(0)
        for c in points[at[i] : at[i + 1]]:
            h = _step(h, c)
        keys[i] = h
    order = np.argsort(keys)
    logs = np.append(logs[order], [np.log(1e-4), np.log(1e-4)])
    return Pieces(keys[order], logs - np.logaddexp.reduce(logs), max(map(len, names)))


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h ^ c) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x2545F4914F6CDD1D) + (h >> np.uint64(29))


def _lattice(points: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, piece index, log probability) of each span of words of one length (rows of code points), ends in order.

    A character that is no piece itself is spelled in unknown bytes.
    """
    n, length = points.shape
    keys, known = pieces.keys, len(pieces.keys)
    spelled = pieces.logs[-1] - np.log(256)
    spans: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {e: [] for e in range(1, length + 1)}
    for start in range(length):
        h = np.zeros(n, dtype=np.uint64)
        for end in range(start + 1, min(length, start + pieces.longest) + 1):
            h = _step(h, points[:, end - 1])
            at = np.minimum(np.searchsorted(keys, h), known - 1)
            hit = keys[at] == h
            logs = np.where(hit, pieces.logs[at], -np.inf)
            index = np.where(hit, at, known + 1)
            if end == start + 1:
                c = points[:, start]
                size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
                logs = np.where(hit, logs, spelled * size)
            elif not hit.any():
                continue
            spans[end].append((start, index, logs))
    for end in range(1, length + 1):
        for start, index, logs in spans[end]:
            yield start, end, index, logs


def log_probabilities(points: np.ndarray, pieces: Pieces, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log of the marginal probability of each word; with ``weights``, also the expected counts of the pieces."""
    n, length = points.shape
    forward = np.full((length + 1, n), -np.inf)
    forward[0] = 0
    spans = list(_lattice(points, pieces))
    for start, end, _, logs in spans:
        forward[end] = np.logaddexp(forward[end], forward[start] + logs)
    if weights is None:
        return forward[length], None
    backward = np.full((length + 1, n), -np.inf)
    backward[length] = 0
    counts = np.zeros(len(pieces.logs))
    for start, end, index, logs in reversed(spans):
        share = logs + backward[end]
        backward[start] = np.logaddexp(backward[start], share)
    for start, end, index, logs in spans:
        counts += np.bincount(index, np.exp(forward[start] + logs + backward[end] - forward[length]) * weights, minlength=len(counts))
    return forward[length], counts


def _hits(points: np.ndarray, first: int, last: int, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece index, log probability) of the spans of one word that end after ``first`` and not after ``last``, ends in order."""
    low = max(0, first - pieces.longest)
    part = points[low:last]
    starts, ends, found, logs = [], [], [], []
    h = np.zeros(len(part), np.uint64)
    for length in range(1, min(pieces.longest, len(part)) + 1):
        h = _step(h[: len(part) - length + 1], part[length - 1 :])
        at = np.minimum(np.searchsorted(pieces.keys, h), len(pieces.keys) - 1)
        hit = pieces.keys[at] == h
        value = pieces.logs[at]
        if length == 1:  # a character that is no piece is spelled in unknown bytes
            size = 1 + (part > 0x7F) + (part > 0x7FF) + (part > 0xFFFF)
            value = np.where(hit, value, (pieces.logs[-1] - np.log(256)) * size)
            at = np.where(hit, at, len(pieces.keys) + 1)
            hit[:] = True
        k = np.flatnonzero(hit)
        k = k[low + k + length > first]
        starts.append(low + k)
        ends.append(low + k + length)
        found.append(at[k])
        logs.append(value[k])
    start, end, index, log = (np.concatenate(x) for x in (starts, ends, found, logs))
    order = np.lexsort((start, end))
    return start[order], end[order], index[order], log[order]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _forward(hits: tuple, first: int, last: int, carried: list[float], longest: int) -> list[float]:
    """Forward values of the places first - longest (less at the word's begin) to last; ``carried`` are those up to first."""
    out, low, start, logs = list(carried), first + 1 - len(carried), hits[0].tolist(), hits[3].tolist()
    cuts = np.searchsorted(hits[1], np.arange(first + 1, last + 2)).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        out.append(_log_sum([out[start[k] - low] + logs[k] for k in range(a, b)]))
    return out


def long_word(points: np.ndarray, pieces: Pieces, weight: float | None = None) -> tuple[float, np.ndarray | None]:
    """Natural log of the marginal probability of one word; with a weight, also the expected counts of the pieces.

    Stretch by stretch; what is kept of earlier stretches is the forward values of the last places, from which they are recurred again on
    the way back.
    """
    length, longest = len(points), pieces.longest
    bounds = [*range(0, length, STRETCH), length]
    kept = [[0.0]]
    for first, last in zip(bounds, bounds[1:], strict=False):
        kept.append(_forward(_hits(points, first, last, pieces), first, last, kept[-1], longest)[-longest:])
    total = kept[-1][-1]
    if weight is None:
        return total, None
    counts = np.zeros(len(pieces.logs))
    after = {length: 0.0}  # backward values of the places that earlier stretches reach
    for first, last, carried in reversed(list(zip(bounds, bounds[1:], kept, strict=False))):
        hits = _hits(points, first, last, pieces)
        fore = np.array(_forward(hits, first, last, carried, longest))
        low = first + 1 - len(carried)
        start, end, index, logs = hits
        back = np.full(last - low + 1, -np.inf)
        for place, value in after.items():
            back[place - low] = value
        rows = list(zip(start.tolist(), end.tolist(), logs.tolist(), strict=True))
        for s, e, log in reversed(rows):
            x, y = back[s - low], log + back[e - low]
            back[s - low] = y if x == -np.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
        counts += np.bincount(index, np.exp(fore[start - low] + logs + back[end - low] - total) * weight, minlength=len(counts))
        after = {p: float(back[p - low]) for p in range(low, first + 1)}
    return total, counts


def marginals(batch: pa.RecordBatch, pieces: Pieces, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each row's word, and the expected counts of all pieces (0 without weights)."""
    out, counts = np.zeros(batch.num_rows), np.zeros(len(pieces.logs))
    for rows, points in _words(batch, pieces.longest):
        if points.shape[1] > LONG:
            found = [long_word(p, pieces, None if weights is None else weights[r]) for r, p in zip(rows, points, strict=True)]
            out[rows] = [x for x, _ in found]
            more = sum((c for _, c in found if c is not None), np.zeros(len(counts)))
        else:
            out[rows], more = log_probabilities(points, pieces, None if weights is None else weights[rows])
        if weights is not None:
            counts += more
    return out, counts


def _words(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, code points with the word mark in front) of groups of words of one length."""
    texts = batch.column("word").to_pylist()
    lengths = np.array([len(t) for t in texts])
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        step = max(1, min(GROUP, 4_000_000 // (length + 1) // longest))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            flat = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(part), -1)
            yield part, np.concatenate([np.full((len(part), 1), 0x2581, dtype=np.uint64), flat.astype(np.uint64)], axis=1)


def word_counts(docs: DataFrame, train: Column) -> DataFrame:
    """h, word, c, n: each distinct word with its count in training rows and in all.

    A task sums up ``HELD`` distinct words before it hands them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held, c, n, texts = none, none, none, []

        def out() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(held), 50_000):
                s = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(held[s]), pa.array([t.decode("utf-8", "replace") for t in texts[s]], pa.string()), pa.array(c[s]), pa.array(n[s])], ["h", "word", "c", "n"])

        for batch in batches:
            data, at = W.text_bytes(batch.column("text"))
            teaches = batch.column("train").to_numpy(zero_copy_only=False)
            for first, end, part, offsets in W.chunks(data, at):
                low = W.LOWER[part]
                start, stop, row = W.word_spans(low, offsets)
                if not len(start):
                    continue
                h, place, inverse = np.unique(W.span_hashes(low, start, stop).view(np.int64), return_index=True, return_inverse=True)
                taught, all_ = np.bincount(inverse, teaches[first:end][row], minlength=len(h)).astype(np.int64), np.bincount(inverse)
                order = np.argsort(held)
                at_ = order[np.minimum(np.searchsorted(held, h, sorter=order), len(held) - 1)] if len(held) else np.zeros(len(h), np.int64)
                known = held[at_] == h if len(held) else np.zeros(len(h), bool)
                c[at_[known]] += taught[known]
                n[at_[known]] += all_[known]
                new = ~known
                held, c, n = np.append(held, h[new]), np.append(c, taught[new]), np.append(n, all_[new])
                texts += [low[a:b].tobytes() for a, b in zip(start[place[new]].tolist(), stop[place[new]].tolist(), strict=True)]
                if len(held) >= HELD:
                    yield from out()
                    held, c, n, texts = none, none.copy(), none.copy(), []
        yield from out()

    rows = docs.select("text", train.alias("train")).mapInArrow(run, "h long, word string, c long, n long")
    return rows.groupBy("h", "word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def learn(counts: DataFrame, texts: int, pieces: Pieces, rounds: int = ROUNDS) -> Pieces:
    """Piece probabilities after ``rounds`` of expectation maximisation; ``texts`` ends are counted beside the pieces.

    What comes to the driver per round is one sum per piece and task.
    """
    size = len(pieces.logs)
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast(pieces)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                total += marginals(batch, shared.value, batch.column("c").to_numpy().astype(float))[1]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["piece", "n"])

        found = counts.where("c > 0").select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        total = np.full(size, 0.01)
        total[found["piece"].to_numpy(dtype=np.int64)] += found["n"].to_numpy()
        total[-2] = texts + 0.5
        pieces = Pieces(pieces.keys, np.log(total / total.sum()), pieces.longest)
    return pieces


def score(docs: DataFrame, held_out: int = 1, parts: int = 5, path: str = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row.

    Null text counts as empty: its only token is the end. Without training rows the vocabulary's own scores are used.
    """
    apart = fold("doc_id", parts) == held_out
    counts = written(word_counts(docs, ~apart), "words")
    texts = docs.where(~apart).count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = sums[0] + texts, sums[1] + (texts > 0)
    pieces = learn(counts, texts, vocabulary(path), rounds) if texts else vocabulary(path)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pieces)

    def recur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = marginals(batch, shared.value)[0] / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), batch.column("n"), pa.array(out)], ["h", "c", "n", "lp"])

    scored = written(counts.select("h", "word", "c", "n").mapInArrow(recur, "h long, c long, n long, lp double"), "scored")
    common = scored.orderBy(F.desc("n"), "h").limit(COMMON).toPandas().sort_values("h")
    table = spark.sparkContext.broadcast(tuple(common[c].to_numpy() for c in ("h", "c", "lp")))
    end_known, end_base, end_score = int(texts > 0), float(np.log10(texts + 0.5)), float(pieces.logs[-2] / np.log(10))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counted, lps = table.value
        for batch in batches:
            data, at = W.text_bytes(batch.column("text"))
            for first, end, part, offsets in W.chunks(data, at):
                uid = batch.column("uid").to_numpy()[first:end]
                h, row = W.words(part, offsets)
                h = h.view(np.int64)
                n = np.bincount(row, minlength=end - first)
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1) if len(keys) else np.zeros(len(h), np.int64)
                hit = keys[place] == h if len(keys) else np.zeros(len(h), bool)
                own, where = place[hit], row[hit]
                sums = [np.bincount(where, x, minlength=end - first).astype(float) for x in (counted[own] > 0, np.log10(counted[own] + 0.5), lps[own])]
                other, at_row = h[~hit], row[~hit]
                order = np.lexsort((other, at_row))
                other, at_row = other[order], at_row[order]
                fresh = np.ones(len(other), bool)
                fresh[1:] = (other[1:] != other[:-1]) | (at_row[1:] != at_row[:-1])
                begin = np.flatnonzero(fresh)
                times = np.diff(np.append(begin, len(other)))
                heads, rest = end - first, len(begin)
                # a document's own row has a key that no word has (its hashed number) and no occurrence
                key = np.concatenate([W.mix(uid.astype(np.uint64)).view(np.int64), other[begin]])
                nulls = lambda x: pa.array(np.concatenate([x, np.zeros(rest, x.dtype)]), mask=np.arange(heads + rest) >= heads)
                ids = pa.concat_arrays([batch.column("doc_id").slice(first, heads), pa.nulls(rest, pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([uid, uid[at_row[begin]]])), pa.array(key), pa.array(np.concatenate([np.zeros(heads, np.int64), times])), ids, nulls(n + 1), nulls(sums[0].astype(np.int64)), nulls(sums[1]), nulls(sums[2])],
                    ["uid", "h", "times", "doc_id", "n_tokens", "known", "base", "lp0"],
                )

    parts_of = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(look_up, "uid long, h long, times long, doc_id long, n_tokens long, known long, base double, lp0 double")
    met = parts_of.join(scored.select("h", "c", "lp"), "h", "left")
    times = F.col("times")
    found = times > 0
    met = met.select(
        "uid", "doc_id", "n_tokens", (F.coalesce("known", F.lit(0)) + F.when(found & (F.col("c") > 0), times).otherwise(0)).alias("known"),
        (F.coalesce("base", F.lit(0.0)) + F.when(found, times * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).otherwise(0)).alias("base"),
        (F.coalesce("lp0", F.lit(0.0)) + F.when(found, times * F.col("lp")).otherwise(0)).alias("lp"),
    )
    sums = met.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("lp").alias("lp"))
    scale = float(np.log10(total + 0.5 * (distinct + 1)))
    return sums.select(
        "doc_id", (fold("doc_id", parts) == held_out).alias("held_out"), "n_tokens", (F.col("known") + end_known).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + end_base - F.col("n_tokens") * scale).alias("base_score"), (F.col("lp") + end_score).alias("score"),
    )
