"""Substring dedup by compaction of a de Bruijn graph.

Every window of ``WIDTH`` words is an edge of the graph, from its first words but one to its last. Consecutive windows of a document with the same
minimizer (the least hash among their runs of ``CORE`` words) are one path; equal windows have equal minimizers, so a minimizer
that occurs once has no repeated window, and only paths of others are kept (a bit filter of bounded size first, exact counts
after it).

Paths that occur more than once are compacted further by joins: path b follows a without a branch if every a is followed by b and every b
follows an a; the ends of documents count as branches. So every occurrence of a compacted path (unitig) holds the whole of it, its first
occurrence is that of each of its parts, and one row per occurrence is left: a span with the coordinates of its source.
Different paths of one minimizer may share windows: these are compared one by one, but only for the first occurrence of each path, as all
windows of later ones are repeats anyhow.

Finally each span and its source are read at their coordinates: SHA-256 digests of the words must agree. If any two differ (a collision of 64-bit
hashes), the work is done anew with another hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.scratch import removed, written
from caselens.llm import words as W
from caselens.llm.bits import bit_filter, passes

WIDTH = 20
CORE = 6
#: Bytes of a text that are read at once.
PIECE = 1 << 20
PATHS = "mini long, path long, doc_id long, tie int, start int, size int, prev long, next long, kmers array<long>"


def pieces(data: np.ndarray, at: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(first row, start, end and row of words, number of the first word) of runs of rows.

    A row longer than ``PIECE`` comes in parts that overlap by width - 1 words, so every window is in exactly one of them.
    """
    for first, _, part, offsets in W.chunks(data, at, PIECE):
        if len(part) <= 2 * PIECE:
            yield first, part, *W.word_spans(part, offsets), 0
            continue
        begin, number, length = 0, 0, PIECE
        while begin < len(part):
            end = begin + length
            while end < len(part) and not W.BLANK[part[end]]:
                end += min(1024, int(np.argmax(W.BLANK[part[end : end + 1024]])) or 1024)
            end = min(end, len(part))
            start, stop, row = W.word_spans(part[begin:end], np.array([0, end - begin]))
            if len(start) < width and end < len(part):
                length *= 2  # a few huge words: take in more
                continue
            yield first, part[begin:end], start, stop, row, number
            if end == len(part):
                break
            number += len(start) - width + 1
            begin, length = begin + int(start[1 - width]), PIECE


def minimizers(hashes: np.ndarray, width: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash of the run at each word); place is that of the least hash of ``core`` words (the first of equals) for the window of ``width`` words that begins at each word."""
    n = len(hashes)
    runs = np.zeros(n, np.uint64)
    for i in range(min(core, n)):
        runs[: n - i] = runs[: n - i] * np.uint64(0xA24BAED4963EE407 | 1) + hashes[i:]
    runs = W.mix(runs)
    place, length, want = np.arange(n), 1, width - core + 1

    def joined(shift: int) -> np.ndarray:
        other = np.append(place[shift:], np.full(min(shift, n), n - 1))[:n]
        return np.where(runs[other] < runs[place], other, place)

    while length * 2 <= want:
        place, length = joined(length), length * 2
    return (joined(want - length) if want > length else place), runs


def spread_sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = W.powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    return total, down


def paths_of(data: np.ndarray, start: np.ndarray, stop: np.ndarray, row: np.ndarray, rows: int, width: int, core: int, seed: int) -> dict[str, np.ndarray] | None:
    """Paths of a run of rows: row, start (word of the row), size (windows), minimizer and content hashes, neighbours; and every window's hash."""
    if len(start) < width:
        return None
    hashes = W.mix(W.span_hashes(data, start, stop) + np.uint64(seed * 0x9FB21C651E98DF25 & W.MASK))
    counts = np.bincount(row, minlength=rows)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    window = np.flatnonzero(firsts[row] + counts[row] - np.arange(len(row)) >= width)
    if not len(window):
        return None
    place, runs = minimizers(hashes, width, core)
    fresh = np.ones(len(window), bool)
    fresh[1:] = (window[1:] != window[:-1] + 1) | (place[window[1:]] != place[window[:-1]])
    at = np.flatnonzero(fresh)
    begin, size = window[at], np.diff(np.append(at, len(window)))
    total, down = spread_sums(hashes)
    path = W.mix((total[begin + size + width - 1] - total[begin]) * down[begin] + size.astype(np.uint64)) | np.uint64(1)
    follows = np.zeros(len(begin), bool)
    follows[1:] = begin[1:] == begin[:-1] + size[:-1]
    prev, after = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
    prev[1:][follows[1:]] = path[:-1][follows[1:]]
    after[:-1][follows[1:]] = path[1:][follows[1:]]
    kmers = W.mix((total[window + width] - total[window]) * down[window])
    return {
        "row": row[begin], "start": begin - firsts[row[begin]], "size": size, "mini": runs[place[begin]].view(np.int64), "path": path.view(np.int64),
        "prev": prev.view(np.int64), "next": after.view(np.int64), "kmers": kmers.view(np.int64), "at": at,
    }


def minimizer_paths(docs: DataFrame, width: int, core: int, seed: int) -> DataFrame:
    """mini, path of every path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part, start, stop, row, _ in pieces(*W.text_bytes(batch.column("text")), width):
                if (p := paths_of(part, start, stop, row, batch.num_rows, width, core, seed)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(p["mini"]), pa.array(p["path"])], ["mini", "path"])

    return docs.select("text").mapInArrow(run, "mini long, path long")


def likely_paths(docs: DataFrame, width: int, core: int, seed: int) -> DataFrame:
    """Occurrences of the paths whose minimizer passes the filter of repeated ones; kmers only where a minimizer may have several paths."""
    spark = docs.sparkSession
    minis = minimizer_paths(docs, width, core, seed).groupBy("mini").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("low"), F.max("path").alias("high"))
    minis = written(minis.where("n > 1").select("mini", (F.col("low") != F.col("high")).alias("several")), "minis")
    filters = spark.sparkContext.broadcast((bit_filter(minis, "mini"), bit_filter(minis.where("several"), "mini")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, several = filters.value
        for batch in batches:
            ids, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tie"))
            for first, part, start, stop, row, number in pieces(*W.text_bytes(batch.column("text")), width):
                if (p := paths_of(part, start, stop, row, batch.num_rows, width, core, seed)) is None:
                    continue
                keep = np.flatnonzero(passes(repeated, p["mini"]))
                size = p["size"][keep]
                shown = passes(several, p["mini"][keep])
                lengths = np.where(shown, size, 0)
                at = np.concatenate([[0], np.cumsum(lengths)])
                inside = np.arange(at[-1]) - np.repeat(at[:-1], lengths) + np.repeat(p["at"][keep], lengths)
                kmers = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(p["kmers"][inside]))
                who = first + p["row"][keep]
                columns = [p["mini"][keep], p["path"][keep], ids[who], ties[who], (p["start"][keep] + number).astype(np.int32), size.astype(np.int32), p["prev"][keep], p["next"][keep]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), kmers], [x.split()[0] for x in PATHS.split(", ")])

    found = written(docs.select("doc_id", "tie", "text").mapInArrow(run, PATHS), "paths")
    removed(minis)
    return found


def place(kind: str = "") -> list[str]:
    return [f"{kind}doc_id", f"{kind}tie", f"{kind}start"]


def unitigs(paths: DataFrame) -> DataFrame:
    """path (the first of the unitig), doc_id, tie, start, windows of each compacted path that occurs more than once."""
    many = paths.where("n > 1").select("path", "at.*", "size", "p0", "p1", "q0", "q1")
    ahead = many.where("q0 = q1").select(F.col("path").alias("p0"), F.col("q0").alias("onward"))
    inner = many.where("p0 = p1").join(ahead, "p0").where("onward = path").select("path").withColumn("inner", F.lit(True))
    chain = Window.partitionBy("doc_id", "tie").orderBy("start")
    named = many.select("path", *place(), "size").join(inner, "path", "left").withColumn("unitig", F.sum(F.when(F.col("inner"), 0).otherwise(1)).over(chain))
    return named.groupBy("doc_id", "tie", "unitig").agg(F.min("start").alias("start"), F.min_by("path", "start").alias("path"), F.sum("size").alias("windows")).drop("unitig")


def spans(occurrences: DataFrame) -> DataFrame:
    """doc_id, tie, start, windows, src_doc_id, src_tie, src_start: windows that repeat, each span with a source that starts earlier."""
    at = F.struct(*place())
    grouped = occurrences.groupBy("mini", "path").agg(
        F.min(at).alias("at"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.any_value("kmers").alias("kmers"),
        F.min("prev").alias("p0"), F.max("prev").alias("p1"), F.min("next").alias("q0"), F.max("next").alias("q1"),
    )
    paths = written(grouped.where("n > 1 or size(kmers) > 0"), "distinct")
    source = [F.col(f"at.{c}").alias(f"src_{c}") for c in place()]
    heads = unitigs(paths).select("path", "windows", F.struct(*place()).alias("at"))
    copies = occurrences.select("path", *place()).join(heads, "path").where(at != F.col("at")).select(*place(), "windows", *source)
    # windows that different paths of a minimizer share
    single = paths.where("size(kmers) > 0").select(F.posexplode("kmers").alias("k", "kmer"), "at.*").withColumn("start", F.col("start") + F.col("k")).drop("k")
    least = single.groupBy("kmer").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = single.join(least, "kmer").where(at > F.col("at")).select(*place(), *source)
    key = ["doc_id", "tie", "src_doc_id", "src_tie", "shift"]
    later = later.withColumn("shift", F.col("start") - F.col("src_start"))
    later = later.withColumn("island", F.col("start") - F.row_number().over(Window.partitionBy(*key).orderBy("start")))
    merged = later.groupBy(*key, "island").agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("windows"), F.min("src_start").alias("src_start"))
    return written(copies.unionByName(merged.drop("shift", "island")), "spans")


def judge(raw: bytes, cover: list[tuple[int, int]], asked: list[tuple[int, int]], width: int) -> tuple[int, int, str, list[str]]:
    """(words, removed words, digest of the kept ones, digests of the asked spans); spans are (first word, windows).

    The text is read in pieces; what is in memory beside it is a piece and its words.
    """
    edges = sorted([(a, 1) for a, n in cover] + [(a + n + width - 1, -1) for a, n in cover])
    kept, digests = hashlib.sha256(), [hashlib.sha256() for _ in asked]
    begin = number = gone = 0
    some = False
    depth, edge = 0, 0
    while begin < len(raw):
        end = begin + PIECE
        while end < len(raw) and not W.BLANK[raw[end]]:
            end += 1
        words = raw[begin:end].split()
        begin, stop, at = end, number + len(words), number
        for (a, n), digest in zip(asked, digests, strict=True):
            if a < stop and a + n + width - 1 > number:
                digest.update(b"".join(w + b" " for w in words[max(0, a - number) : a + n + width - 1 - number]))
        while at < stop:
            while edge < len(edges) and edges[edge][0] <= at:
                depth += edges[edge][1]
                edge += 1
            until = min(stop, edges[edge][0]) if edge < len(edges) else stop
            if depth:
                gone += until - at
            else:
                kept.update((b" " if some else b"") + b" ".join(words[at - number : until - number]))
                some = True
            at = until
        number = stop
    return number, gone, kept.hexdigest(), [d.hexdigest()[:32] for d in digests]


def cut(docs: DataFrame, found: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(results of the documents that no span names, those of the others with their digests: checks of start, windows, digest)."""
    own = found.select("doc_id", "tie", F.struct("start", "windows", F.lit(True).alias("cover")).alias("ask"))
    sources = found.select(F.col("src_doc_id").alias("doc_id"), F.col("src_tie").alias("tie"), F.struct(F.col("src_start").alias("start"), "windows", F.lit(False).alias("cover")).alias("ask"))
    asks = written(own.unionByName(sources.distinct()).groupBy("doc_id", "tie").agg(F.collect_list("ask").alias("asks")), "asks")
    key = F.xxhash64("doc_id", "tie")
    named = docs.sparkSession.sparkContext.broadcast(bit_filter(asks.select(key.alias("key")), "key"))
    checks = "checks array<struct<start int, windows long, digest string>>"

    def judged(batch: pa.RecordBatch, asked: list) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("windows", pa.int64()), ("digest", pa.string())]))
        rows = []
        for text, asks_ in zip(batch.column("text"), asked, strict=True):
            wanted = [(a["start"], a["windows"]) for a in asks_ or ()]
            cover = [s for s, a in zip(wanted, asks_ or (), strict=True) if a["cover"]]
            n, gone, digest, seen = judge(text.as_buffer().to_pybytes() if text.is_valid else b"", cover, wanted, width)
            rows.append((n, gone, digest, [{"start": a, "windows": b, "digest": d} for (a, b), d in zip(wanted, seen, strict=True)]))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), kind), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), *arrays], ["doc_id", "tie", "n_words", "n_removed", "kept_sha256", "checks"])

    def unnamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~passes(named.value, batch.column("key").to_numpy())))
            yield judged(batch, [None] * batch.num_rows)

    def maybe_named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(named.value, batch.column("key").to_numpy())))

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield judged(batch, batch.column("asks").to_pylist())

    schema = f"doc_id long, tie int, n_words long, n_removed long, kept_sha256 string, {checks}"
    keyed = docs.select("doc_id", "tie", "text", key.alias("key"))
    alone = keyed.mapInArrow(unnamed, schema)
    asked = keyed.mapInArrow(maybe_named, keyed.schema).drop("key").join(asks, ["doc_id", "tie"], "left").mapInArrow(answered, schema)
    return alone, written(asked, "judged")


def differing(found: DataFrame, judged: DataFrame) -> DataFrame:
    """Spans whose words differ from those of their source."""
    seen = judged.select("doc_id", "tie", F.explode("checks").alias("c")).select("doc_id", "tie", "c.*").distinct()
    source = seen.select(*[F.col(c).alias(f"src_{c}") for c in place()], "windows", F.col("digest").alias("src_digest"))
    both = found.join(seen, [*place(), "windows"], "left").join(source, [*place("src_"), "windows"], "left")
    return both.where(~F.coalesce(F.col("digest") == F.col("src_digest"), F.lit(False)))


def remove_repeats(docs: DataFrame, width: int = WIDTH, core: int = CORE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row: words covered by a window of ``width`` words that starts earlier elsewhere are removed.

    A null text has no words. Rows with a null doc_id have no place in the order: nothing is removed from them and they are no source.
    Of rows that share a doc_id, different texts are documents of their own, ordered by a hash of the text, and equal ones are one
    document with equal results. Other columns are not read.
    """
    for seed in range(8):
        base = docs.select("doc_id", "text", F.hash("text").alias("tie"))
        found = spans(likely_paths(base.where("doc_id is not null and text is not null"), width, core, seed))
        alone, judged = cut(base, found, width)
        if differing(found, judged).isEmpty():
            return reduce(DataFrame.unionByName, (x.select("doc_id", "n_words", "n_removed", "kept_sha256") for x in (alone, judged)))
    raise RuntimeError("hashes collide with every seed")
